"""Parquet tables that carry their contract: written once, checked when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_contract(df: DataFrame, contract: str, **provenance: str) -> DataFrame:
    """Marks the first column with the contract id and provenance; column metadata survives a Parquet round trip."""
    first = df.columns[0]
    return df.withMetadata(first, {"contract": contract, **provenance})


def contract_of(df: DataFrame) -> dict[str, str]:
    return dict(df.schema[0].metadata)


def require_contract(df: DataFrame, contract: str, **provenance: str) -> DataFrame:
    """The DataFrame, or ValueError where its marks differ."""
    found = contract_of(df)
    if any(found.get(k) != v for k, v in {"contract": contract, **provenance}.items()):
        raise ValueError(f"expected {contract} {provenance}, found {found or 'no contract'}")
    return df


def require_compatible(features: DataFrame, labels: DataFrame) -> None:
    """Features and labels must come from the same bar contract."""
    a, b = contract_of(features).get("bars"), contract_of(labels).get("bars")
    if not a or a != b:
        raise ValueError(f"features come from {a}, labels from {b}")


def require_not_null(df: DataFrame, *columns: str) -> None:
    """Raise where a key column holds a null; Parquet does not keep that a column is not nullable."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    if not df.where(bad).isEmpty():
        raise ValueError(f"null in {columns}")


def write_table(df: DataFrame, path: str, contract: str | None = None, rows_per_file: int = 0, **provenance: str) -> None:
    """Write once, zstd-compressed; an existing path is an error and the committer publishes all files or none."""
    if contract:
        df = with_contract(df, contract, **provenance)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str, contract: str | None = None, **provenance: str) -> DataFrame:
    df = spark.read.parquet(path)
    return require_contract(df, contract, **provenance) if contract else df


def compact(df: DataFrame, path: str, rows_per_file: int, *order: str) -> None:
    """Rewrite in range order with files of a bounded number of rows."""
    write_table(df.repartitionByRange(*order).sortWithinPartitions(*order), path, rows_per_file=rows_per_file)
