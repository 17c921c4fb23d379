"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct text chunks that one Python worker remembers before it starts afresh.
CACHE_ENTRIES = 600_000
#: Longer chunks are computed each time and not remembered.
CACHE_CHUNK_CHARS = 64


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables: ``spark.checkpoint.dir``, or where unset and all runs in one process a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='quotewright-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    ``batch_rows`` bounds the rows that Python gets at a time while this is written, where rows are large.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_ROWS)
    try:
        if batch_rows:
            spark.conf.set(BATCH_ROWS, str(batch_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Delete tables written by ``stored`` that no later plan reads."""
    for df in tables:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text_col: str) -> Column:
    """A 64-bit name of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _at(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` (i, k, row) joined with ``keys`` (id, key), where null ids meet."""
    keys = keys.select(F.col("id").alias("ki"), F.col("key").alias("kk"))
    return rows.join(keys, F.col("i").eqNullSafe(F.col("ki")) & (F.col("k") == F.col("kk")), how)


def leave_out(docs: DataFrame, gone: DataFrame, twice: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``docs`` with all its columns, without the rows whose (id, ``key``) is in ``gone`` and with one row for each in ``twice``.

    Both hold distinct (id, key). Of the rows that share a pair of ``twice`` the one with the least hash of all its columns stays.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), key.alias("k"), F.struct("*").alias("row"))
    stay = _at(rows, gone, "left_anti")
    if twice.isEmpty():
        return stay.select("row.*")
    one = _at(stay, twice, "left_semi").groupBy("i", "k").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return _at(stay, twice, "left_anti").select("row.*").union(one.select("row.*"))


class Rows:
    """The rows of a table with an id, each under a long of its own: the id, or where ids repeat a number of (id, text) in the order of ids.

    Rows that repeat both id and text share their number.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, label: str):
        self.docs, self.id_col, self.key, self.numbers = docs, id_col, text_key(text_col), None
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
        self.texts = rows
        if not rows.groupBy("id").count().where("count > 1").isEmpty():
            pairs = rows.select("id", text_key("text").alias("key")).distinct()
            self.numbers = stored(pairs.repartitionByRange("id", "key").sortWithinPartitions("id", "key").withColumn("row", F.monotonically_increasing_id()), f"{label}-rows")
            held = rows.withColumn("key", text_key("text")).join(self.numbers, ["id", "key"])
            self.texts = held.groupBy("row").agg(F.first("text").alias("text")).select(F.col("row").alias("id"), "text")

    def with_ids(self, df: DataFrame, *columns: str) -> DataFrame:
        """``df`` with the ids that go with the rows in ``columns``."""
        order = df.columns
        for c in columns if self.numbers is not None else ():
            df = df.withColumnRenamed(c, "row").join(self.numbers.select("row", F.col("id").alias(c)), "row").drop("row")
        return df.select(order)

    def joined(self, values: DataFrame, how: str = "left") -> DataFrame:
        """(row, values...): each row of the table as a struct, and the ``values`` that go with its number (column ``id``), else null."""
        more = [c for c in values.columns if c != "id"]
        if self.numbers is not None:
            values = values.withColumnRenamed("id", "row").join(self.numbers, "row").drop("row")
            rows = self.docs.select(F.col(self.id_col).cast("long").alias("i"), self.key.alias("k"), F.struct("*").alias("held"))
            values = values.select(F.col("id").alias("i"), F.col("key").alias("k"), *more)
            return rows.join(values, ["i", "k"], how).select(F.col("held").alias("row"), *(more if how == "left" else ()))
        rows = self.docs.select(F.col(self.id_col).cast("long").alias("i"), F.struct("*").alias("row"))
        return rows.join(values.withColumnRenamed("id", "i"), "i", how).select("row", *(more if how == "left" else ()))

    def without(self, gone: DataFrame) -> DataFrame:
        """The table without the rows whose numbers are in ``gone`` (id), and without repeats of id and text; rows without id stay."""
        if self.numbers is None:
            return self.joined(gone, "left_anti").select("row.*")
        held = self.docs.select(F.col(self.id_col).cast("long").alias("id"), self.key.alias("key")).where("id IS NOT NULL")
        twice = held.groupBy("id", "key").count().where("count > 1").select("id", "key")
        gone = gone.withColumnRenamed("id", "row").join(self.numbers, "row").select("id", "key")
        return leave_out(self.docs, gone, twice, self.id_col, self.key)


def map_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    return df.mapInArrow(rows, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


class ChunkCache(dict):
    """chunk -> packed bytes, computed by ``make`` at the first use; bounded in entries and in chunk length.

    ``gather(chunks)`` joins the packed values of a document's chunks. Memory stays bounded because the
    table is emptied when full and long chunks never enter it.
    """

    def __init__(self, make: Callable[[str], bytes], entries: int = CACHE_ENTRIES // 2):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, chunk):
        value = self.make(chunk)
        if len(chunk) <= CACHE_CHUNK_CHARS:
            if len(self) >= self.entries:
                self.clear()
            self[chunk] = value
        return value

    def gather(self, chunks) -> bytes:
        return b"".join(map(self.__getitem__, chunks))


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for undirected ``edges`` (a, b) of non-null longs; the component is its smallest node.

    Alternating large-star and small-star rounds. Minima are aggregated before the shuffle, written, and joined
    back, so that adaptive execution can split the rows of a node with very many neighbours; each round is a written table.
    The rounds end when every node is a smallest one or has one edge down and none up, which the first minima of a round tell;
    only that answer reaches the driver. Self loops are allowed and name isolated nodes; null ends are dropped.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    nodes = pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "node")
    nodes = stored(nodes, f"{label}-nodes")
    now = stored(pairs.where("u <> v").distinct(), f"{label}-cc")
    while True:
        both = now.union(now.select("v", "u"))
        down, up = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), ((down > 1) | (down > 0) & (up > 0)).alias("open"))
        least = stored(least.select("u", F.least("u", "m").alias("m"), "open"), f"{label}-least")
        if least.where("open").isEmpty():
            discard(least)
            break
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, f"{label}-cc")
        discard(least)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), f"{label}-least")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        small = stored(small, f"{label}-cc")
        discard(large, least, now)
        now = small
    return nodes.join(now.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
