"""Sharding by minimax contiguous partition of ordered atomic groups.

Equal texts form a group that one shard holds whole. Groups are ordered by the SHA-256 of their text; the smallest
shard capacity for which a greedy walk needs no more than ``shards`` shards is found by binary search, and the order is
cut there. The driver never holds all groups: it first searches over sums of hash-prefix bins, which bounds the capacity
and each cut from both sides, and then reads only the bins between the bounds at longer prefixes until the bounds agree.

Defined results: a null text has size 1, CRC-32 zero and is grouped with the empty text; rows that repeat an id
stay rows of their own; null ids come first within a group. With fewer groups than shards the last shards stay
empty. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Hexadecimal digits by which a bin's prefix grows at each level: 4,096 bins to a bin of the level before.
STEP_DIGITS = 3
#: A group of at least this share of a mean shard is a bin of its own from the start; there are no more than shards times this.
HEAVY_PARTS = 32


def walk(ends: np.ndarray, atomic: np.ndarray, capacity: int, shards: int, hopeful: bool) -> list[int]:
    """Positions (cumulative sizes) where a greedy walk over bins cuts; the last is the total if all fits.

    A bin that is not atomic holds several groups whose borders are not known: the hopeful walk cuts it anywhere, the
    other one only at its ends, so the true walk lies between them.
    """
    total, at, out = int(ends[-1]), 0, []
    for _ in range(shards):
        upto = at + capacity
        if upto >= total:
            at = total
        else:
            i = int(np.searchsorted(ends, upto, side="right"))
            if not hopeful or atomic[i]:
                upto = int(ends[i - 1]) if i else 0
            at = max(at, upto)
        out.append(at)
    return out


def least_capacity(ends: np.ndarray, atomic: np.ndarray, shards: int, low: int, hopeful: bool) -> int:
    """By binary search the smallest capacity, ``low`` or more, with which the walk reaches the end."""
    total = high = int(ends[-1])
    low, high = min(low, total), max(low, total)
    while low < high:
        mid = (low + high) // 2
        if walk(ends, atomic, mid, shards, hopeful)[-1] < total:
            low = mid + 1
        else:
            high = mid
    return low


def shard_starts(groups: DataFrame, shards: int) -> list[str]:
    """For shards 1 and up, the first group key each holds; ``groups`` has (key, size) with hexadecimal keys.

    Each level bounds the least capacity from below (hopeful walk) and above (walk over whole bins), and so each cut to
    a window; only bins in these windows are read again at a longer prefix, until the two bounds agree.
    """
    total, floor = groups.agg(F.sum("size"), F.max("size")).first()
    if total is None:
        return []
    heavy_size = max(1, -(-total // (shards * HEAVY_PARTS)))
    heavy = sorted((r["key"], r["size"]) for r in groups.where(F.col("size") >= heavy_size).collect())
    light = groups.where(F.col("size") < heavy_size)
    after = F.lit("")
    if heavy:
        after = F.coalesce(F.concat(F.array_max(F.filter(F.array(*[F.lit(k) for k, _ in heavy]), lambda h: h < F.col("key"))), F.lit("~")), F.lit(""))

    def bins(rows: DataFrame, digits: int) -> list[tuple]:
        """(first key, size, whether it is one group) of light groups' bins: a common prefix, and no heavy group between."""
        first = F.greatest(F.substring("key", 1, digits), after).alias("first")
        return [(r["first"], r["size"], r["n"] == 1) for r in rows.groupBy(first).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()]

    digits = STEP_DIGITS
    table = sorted([(k, n, True) for k, n in heavy] + bins(light, digits))
    while True:
        ends = np.cumsum(np.array([n for _, n, _ in table], np.int64))
        begins = np.concatenate(([0], ends[:-1]))
        atomic = np.array([one for _, _, one in table])
        low = least_capacity(ends, atomic, shards, max(floor, -(-total // shards)), True)
        high = least_capacity(ends, atomic, shards, low, False)
        windows = []
        for least, most in zip(walk(ends, atomic, low, shards, False), walk(ends, atomic, high, shards, True), strict=True):
            inside = np.flatnonzero(~atomic & (ends > least) & (begins < most))
            if len(inside):
                windows.append((int(inside[0]), int(inside[-1]) + 1))
        if low == high or not windows:
            break
        digits += STEP_DIGITS
        chosen, again = F.lit(False), set()
        for a, b in windows:
            chosen = chosen | ((F.col("key") >= table[a][0]) & (F.col("key") < (table[b][0] if b < len(table) else "~")))
            again.update(range(a, b))
        kept = [r for i, r in enumerate(table) if i not in again or r[1] >= heavy_size and r[2]]
        table = sorted(kept + bins(light.where(chosen), digits))
    keys = [k for k, _, _ in table]
    cuts = np.searchsorted(begins, walk(ends, atomic, high, shards, False)[:-1], side="left")
    return [keys[c] if c < len(keys) else "~" for c in cuts]


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot), one row for each row of ``docs``.

    Slots are ranks in (group, id) order. Rows are dealt by ranges of both, so a group with very many rows is split over
    tasks; a rank is the row's place in its range plus the rows of the ranges before it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("key"))
    rows = stored(rows, "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    starts = shard_starts(stored(groups, "shard-groups"), shards)
    shard = F.lit(0)
    for s in starts:
        shard = shard + (F.col("key") >= s).cast("int")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, "key", F.col("id").asc_nulls_first()).sortWithinPartitions("key", F.col("id").asc_nulls_first())
    at = F.monotonically_increasing_id()
    placed = stored(ranged.select("id", "size", "text_crc32", shard.alias("shard"), F.shiftrightunsigned(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("place")), "shard-placed")
    # One row for each range and shard it touches: as many as tasks plus shards.
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("place").alias("first")).orderBy("shard", "part").collect()
    base, shift, now = [], 0, None
    for r in counts:
        shift = 0 if r["shard"] != now else shift
        now = r["shard"]
        base.append((r["shard"], r["part"], shift - r["first"]))
        shift += r["n"]
    table = F.broadcast(rows.sparkSession.createDataFrame(base, "shard int, part long, base long"))
    return placed.join(table, ["shard", "part"]).select("id", "size", "text_crc32", "shard", (F.col("place") + F.col("base")).alias("slot"))
