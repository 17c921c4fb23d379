"""Exact dedup by progressive refinement: length groups, then prefix hashes, then full hashes [native].

Only DataFrame functions run. Each level reads more of a text, but only for rows whose group still has
more than one member after the level before.

Defined results: a null text counts as empty; texts are equal when identical after lower-casing A-Z
only; the row with the largest id stays. Rows that repeat an id and the text count in ``group_size`` and share
``kept``; rows that repeat an id with different texts are in different groups. A null id never wins over a non-null one,
and a group of null ids only has a null ``keep_id`` and keeps all its rows. ``drop_exact_duplicates`` leaves one row
of each group, also where the id that stays is repeated or null. An empty table gives an empty result. Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, leave_out, stored

#: Characters of the normalised text in the second level's hash.
PREFIX_CHARS = 64
#: Surviving (length, prefix) keys up to this number (16 bytes each, 16 MB) are broadcast; more are shuffled.
BROADCAST_KEYS = 1_000_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: str | Column) -> Column:
    """Lower-case A-Z only; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def _length(text_col: str) -> Column:
    return F.octet_length(F.coalesce(text_col, F.lit("")))


def _small(keys: DataFrame) -> DataFrame:
    """Keys to join with: a broadcast up to ``BROADCAST_KEYS``."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def surviving_keys(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(size, prefix) keys held by two or more rows; prefixes are hashed only of rows whose length another row has."""
    sizes = stored(docs.groupBy(_length(text_col).alias("size")).agg(F.count("*").alias("n")).where("n > 1").select("size"), "exact-sizes")
    rows = docs.select(_length(text_col).alias("size"), F.substring(F.col(text_col), 1, PREFIX_CHARS).alias("head"))
    heads = rows.join(_small(sizes), "size", "left_semi").select("size", F.xxhash64(normalised("head")).alias("prefix"))
    keys = stored(heads.groupBy("size", "prefix").agg(F.count("*").alias("n")).where("n > 1").select("size", "prefix"), "exact-keys")
    discard(sizes)
    return keys


def full_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, full_hash, extra...), written: the SHA-256 of the normalised text where the row survives both cheap levels, else null.

    ``extra`` columns may use ``norm``, the normalised text; they are for callers that need a digest of every row.
    """
    keys = surviving_keys(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("norm"), _length(text_col).alias("size"), F.xxhash64(normalised(F.substring(F.col(text_col), 1, PREFIX_CHARS))).alias("prefix"))
    more = [c.alias(k) for k, c in (extra or {}).items()]
    joined = rows.join(_small(keys.withColumn("hit", F.lit(True))), ["size", "prefix"], "left")
    found = stored(joined.select("id", F.when(F.col("hit"), F.sha2("norm", 256)).alias("full_hash"), *more), "exact-full")
    discard(keys)
    return found


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, extra...), one row for each row of ``docs``.

    A group of copies is aggregated before the shuffle and joined back by its hash; lone rows skip that
    join, so that they do not meet in one task.
    """
    found = full_hashes(docs, id_col, text_col, extra)
    more = list(extra or {})
    alike = found.where("full_hash IS NOT NULL")
    # Written, so that the join reads both sides from plain exchanges, which adaptive execution can split where a group is large.
    groups = stored(alike.groupBy("full_hash").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "exact-groups")
    kept = F.coalesce(F.col("keep_id") == F.col("id"), F.col("keep_id").isNull()).alias("kept")
    lone = found.where("full_hash IS NULL").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *more)
    return alike.join(groups, "full_hash").select("id", "keep_id", "group_size", kept, *more).union(lone)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and one row of each group of equal texts, one with the largest id.

    Decisions are joined back by id and text, so another text under the same id is not touched.
    """
    found = exact_duplicates(docs, id_col, text_col, {"key": F.xxhash64("norm")}).where("group_size > 1")
    gone = found.where("NOT kept").select("id", "key").distinct()
    twice = found.where("kept").groupBy("id", "key").count().where("count > 1").select("id", "key")
    return leave_out(docs, gone, twice, id_col, F.xxhash64(normalised(text_col)))
