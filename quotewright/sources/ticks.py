"""Tick sources: the adapter from event rows, dataset scans, and checks of files against their manifest."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import PAIRS, TICK_COLUMNS

#: Where the compressed time line of adapted events begins, and by how much it is compressed.
EPOCH = 1_704_067_200_000_000
COMPRESSION = 48


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Deterministic bid/ask ticks: one for each event, the pair by user, prices by value."""
    pairs = F.array(*[F.lit(p) for p in PAIRS])
    ts = F.expr(f"{EPOCH} + (unix_micros(cast(ts as timestamp)) - {EPOCH}) div {COMPRESSION}")
    rows = events.select(
        F.element_at(pairs, (F.pmod("user_id", F.lit(len(PAIRS))) + 1).cast("int")).alias("symbol"),
        ts.alias("ts"),
        F.col("event_id").alias("seq"),
        (F.lit(1).cast("double") + F.floor(F.col("value") * 100).cast("double") / 100_000).alias("bid"),
        ((1 + F.pmod("event_id", F.lit(3))).cast("double") / 10_000).alias("__gap"),
    )
    rows = rows.withColumn("ask", F.col("bid") + F.col("__gap"))
    return rows.select("symbol", "ts", "seq", "bid", "ask", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), (F.col("ask") - F.col("bid")).alias("spread"))


def canonical_ticks(ticks: DataFrame) -> DataFrame:
    """Fixed column order and types."""
    kinds = {"symbol": "string", "ts": "long", "seq": "long"}
    return ticks.select(*[F.col(c).cast(kinds.get(c, "double")) for c in TICK_COLUMNS])


def validate_tick_schema(df: DataFrame) -> None:
    want = {"symbol": "string", "ts": "bigint", "seq": "bigint"} | dict.fromkeys(("bid", "ask", "mid", "spread"), "double")
    if dict(df.dtypes) != want or tuple(df.columns) != TICK_COLUMNS:
        raise ValueError(f"tick columns must be {want}, found {df.dtypes}")


def scan_range(ticks: DataFrame, start: int | None = None, end: int | None = None, column: str = "ts") -> DataFrame:
    """Rows of the half-open range; the comparison with literals is pushed to the Parquet scan."""
    for bound, above in ((start, True), (end, False)):
        if bound is not None:
            ticks = ticks.where(F.col(column) >= bound if above else F.col(column) < bound)
    return ticks


def scan_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet files below a folder with one folder for each stream; physical order is (path, row) order.

    Nanosecond timestamps are read as BIGINT when ``spark.sql.legacy.parquet.nanosAsLong`` is set.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
    path = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(path, "/([A-Z]{6})/[^/]*$", 1).alias("symbol"), path.alias("file_path"), F.col("_metadata.row_index").alias("row_index"))


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size_bytes, sha256) of every file below a folder, hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def verify_files(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Differences between files and their manifest, both (path, size_bytes, sha256): missing, extra or altered."""
    m = manifest.select("path", F.col("size_bytes").alias("m_size"), F.col("sha256").alias("m_sha"))
    joined = found.join(m, "path", "full_outer")
    status = F.when(F.col("sha256").isNull(), "missing").when(F.col("m_sha").isNull(), "extra").when((F.col("sha256") != F.col("m_sha")) | (F.col("size_bytes") != F.col("m_size")), "altered")
    return joined.select("path", status.alias("status")).where("status IS NOT NULL")


def inventory_diff(listed: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """(key, status) of keys on one side only: ``missing`` from the listing or ``extra`` in it."""
    missing = manifest.select(key).join(listed.select(key), key, "left_anti").withColumn("status", F.lit("missing"))
    extra = listed.select(key).join(manifest.select(key), key, "left_anti").withColumn("status", F.lit("extra"))
    return missing.unionByName(extra).distinct()


def interval_check(ticks: DataFrame, start: int, end: int) -> DataFrame:
    """For each symbol: rows, first and last time, rows out of order, rows outside the half-open interval."""
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("seq"))
    rows = ticks.select("symbol", "ts", (F.col("ts") < before).alias("back"))
    return rows.groupBy("symbol").agg(
        F.count("*").alias("n_rows"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count_if("back").alias("out_of_order"),
        F.count_if((F.col("ts") < start) | (F.col("ts") >= end)).alias("outside"),
    )


def split_plan(sizes: list[int], target: int) -> list[list[int]]:
    """Row groups dealt to parts in order: a part closes before it would exceed the target, and holds one group at least."""
    if target <= 0:
        raise ValueError("the target must be positive")
    parts: list[list[int]] = []
    room = 0
    for at, n in enumerate(sizes):
        if n < 0:
            raise ValueError("sizes must not be negative")
        if not parts or n > room:
            parts.append([])
            room = target
        parts[-1].append(at)
        room -= n
    return parts


def dataset_manifest(spark: SparkSession, folder: str) -> dict:
    """Content-addressed manifest of a folder's files, ordered by path; files are hashed on the executors."""
    from ..plans.records import content_id

    root = folder.rstrip("/")
    files = [{"path": r["path"].split(root.split(":")[-1].lstrip("/"))[-1].lstrip("/"), "size_bytes": r["size_bytes"], "sha256": r["sha256"]} for r in file_hashes(spark, folder).orderBy("path").collect()]
    body = {"format_version": 1, "files": files}
    return body | {"dataset_id": content_id(body)}


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
