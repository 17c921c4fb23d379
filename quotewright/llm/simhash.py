"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words with repeats, joined by a
space (fewer words: the whole sequence), XXH64 with seed 42; a bit is set when it is set in over half of the
hashes. Fingerprints link at three or fewer differing bits.

Search: of two fingerprints that differ in three bits or fewer, one 32-bit half differs in at most one, which is
half the radius rounded down. Every distinct fingerprint emits all variants of each half within that half radius,
variants are shuffled, and pairs that collide on (half, variant) are deduplicated and verified. A variant that more
than ``PAIR_CAP`` fingerprints hold exactly is not paired: its members meet once more on variants of their other half,
and each such ball is linked to one centre. Those links are all valid and keep every connection, so nothing is lost and
the work stays linear in the rows of a group.

Defined results: a null or word-free text has fingerprint zero and links like any other; a null id takes no part in
components and gets a null ``component_id``; rows that repeat an id are one document each and share a component
when their texts link. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, stored

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
#: Fingerprints that share one half exactly are compared pair by pair up to this number, by balls beyond it.
PAIR_CAP = 48
LOW = 0xFFFFFFFF


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole, n = b" ".join(words), len(words) - SHINGLE_WORDS + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    digest, ends = xxhash.xxh64_intdigest, ends[SHINGLE_WORDS - 1 :].tolist()
    return majority(np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64))


def majority(hashes) -> int:
    """The 64 bits that are set in over half of the hashes."""
    import numpy as np

    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(prints)], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with the fingerprint's 64 bits in a signed long."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_fingerprints, "id long, fp long")


def _masks(upto: int) -> list[int]:
    """XOR masks of 32 bits with ``upto`` or fewer bits set."""
    masks = [0] + [1 << i for i in range(32)]
    return masks if upto < 2 else masks + [1 << i | 1 << j for i in range(32) for j in range(i)]


def _ball(value: Column, masks: list[int]) -> Column:
    return F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m)))


def _halves(prints: DataFrame) -> DataFrame:
    """(fp, half, own, other): either half of each fingerprint; the high half's own value is tagged by bit 32."""
    low, high = F.col("fp").bitwiseAND(LOW), F.shiftrightunsigned("fp", 32)
    half = F.explode(F.array(F.struct(low.alias("own"), high.alias("other")), F.struct(high.bitwiseOR(1 << 32).alias("own"), low.alias("other"))))
    return prints.select("fp", half.alias("x")).select("fp", "x.own", "x.other")


def links(prints: DataFrame) -> DataFrame:
    """(a, b) pairs of distinct fingerprints (column ``fp``, distinct and not null) within the radius.

    Up to ``PAIR_CAP`` fingerprints to a half, every pair within the radius is there; beyond it, enough of
    them to keep every connection.
    """
    exact = _halves(prints)
    near = exact.select("fp", "other", "own", _ball(F.col("own"), _masks(1)).alias("key"))
    sizes = exact.groupBy("own").agg(F.count("*").alias("n"))
    crowded = stored(sizes.where(F.col("n") > PAIR_CAP).select("own"), "simhash-crowded")
    some = not crowded.isEmpty()
    alone = exact.join(crowded, "own", "left_anti") if some else exact
    pairs = near.select("fp", "key").join(alone.select(F.col("own").alias("key"), F.col("fp").alias("a")), "key").where((F.col("a") != F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= RADIUS))
    found = pairs.select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
    if some:
        members = stored(near.join(crowded.withColumnRenamed("own", "key"), "key", "left_semi"), "simhash-members")
        inner = members.select("fp", "key", (F.col("own") == F.col("key")).alias("holds"), _ball(F.col("other"), _masks(1)).alias("z"))
        outer = members.where("own = key").select("fp", "key", F.lit(False).alias("holds"), _ball(F.col("other"), _masks(2)[33:]).alias("z"))
        centre = inner.where("holds").groupBy("key", "z").agg(F.min("fp").alias("c"))
        stars = inner.union(outer).join(centre, ["key", "z"]).where("fp <> c")
        found = found.union(stars.select(F.least("c", "fp").alias("a"), F.greatest("c", "fp").alias("b")))
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id), one row for each row of ``docs``; the component's smallest id names it."""
    prints = stored(fingerprints(docs, id_col, text_col), "simhash-prints")
    firsts = stored(prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("first")), "simhash-firsts")
    edges = stored(links(firsts.select("fp")), "simhash-links")
    parts = connected_components(edges, "simhash")
    named = firsts.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = stored(named, "simhash-named")
    discard(firsts, edges)
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return prints.join(ids, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
