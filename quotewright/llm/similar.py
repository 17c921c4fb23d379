"""Near-dedup of the pipeline: SimHash ball hashing for the near end, completed to the exact similarity of word-shingle sets.

Shingles: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, sets of five successive words (fewer words: the whole sequence), as
XXH64. Two texts link when the Jaccard similarity of their sets is 0.8 or more; no link rests on an estimate.

Search: texts with equal sets are one node. Nodes whose SimHash fingerprints (of the same shingles) differ in three bits or fewer are
candidates, found as ``simhash`` finds them. That radius reaches few pairs down to a similarity of 0.8, whose fingerprints differ in some
ten bits, and balls that wide are out of reach. So a node also has ``BANDS`` keys of ``ROWS`` minima each; nodes that share a
key are candidates too, and a pair of similarity 0.8 shares none with a chance of 3 in a million (less above). In buckets up to
``PAIR_CAP`` every pair is verified. Members of larger buckets are verified against a few centres first. Buckets that the links so far
leave in several components are searched by prefixes: shingles are ordered from the rarest on, and similar sets share one among the first
of either, the fewer the closer their sizes are. Prefixes are therefore cut for each pair of size classes, and a pair of different
components that shares one is verified unless the places of the shared shingle rule the similarity out.

Defined results: texts that are null or without words have one set, the empty sequence, and link with each other alone; null ids
take no part and stay; of rows that repeat id and text one stays, and rows that repeat an id with different texts are documents of their
own, the one with the lesser text hash being the smaller. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import Rows, connected_components, discard, stored

SHINGLE_WORDS = 5
SEED = 42
#: Similarity as a fraction of whole numbers.
SIMILARITY = (4, 5)
BANDS, ROWS = 32, 5
#: Size classes to the factor e: one holds sizes that differ by 5 % at most.
CLASSES = 20.5
#: Buckets up to this many nodes are compared pair by pair, larger ones by centres first.
PAIR_CAP = 8
CENTRES = 3
#: Rows with two texts that Python gets at a time.
BATCH_ROWS = 500
#: Shingles whose permuted hashes are held at once.
BLOCK = 2_048


def shingles(text: str | None):
    """The distinct hashes of a text's shingles, in order."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    whole, n = b" ".join(words), len(words) - SHINGLE_WORDS + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([digest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    return np.unique(np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)], np.uint64))


def node_of(hashes) -> int:
    """A signed 64-bit name of a set of shingles."""
    import numpy as np
    import xxhash

    return int(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def alike(x, y) -> bool:
    """Whether two sets of distinct hashes are similar enough."""
    import numpy as np

    both = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILARITY[1] * both >= SIMILARITY[0] * (len(x) + len(y) - both)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
    weights = rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        nodes, sizes, keys, prints = [], [], [], []
        for text in batch.column(1):
            hashes = shingles(text.as_py())
            least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
            for a in range(0, len(hashes), BLOCK):
                part = hashes[a : a + BLOCK] ^ flip
                part *= odd
                np.minimum(least, part.min(axis=1), out=least)
            mixed = least ^ (least >> np.uint64(31))
            band = (mixed.reshape(BANDS, ROWS) * weights).sum(axis=1, dtype=np.uint64)
            keys.append(band ^ (band >> np.uint64(29)))
            nodes.append(node_of(hashes))
            sizes.append(len(hashes))
            prints.append(simhash.majority(hashes))
        flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), lists, pa.array(np.array(prints, np.uint64).view(np.int64))], ["id", "node", "n", "keys", "fp"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, x = None, None
    for batch in batches:
        out: list[tuple[int, int]] = []
        for a, b, s, t in zip(*(batch.column(c) for c in range(4)), strict=True):
            a, b = a.as_py(), b.as_py()
            if a != last:
                last, x = a, shingles(s.as_py())
            y = shingles(t.as_py())
            if alike(x, y):
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, token) for each shingle of a text."""
    import numpy as np

    for batch in batches:
        found = [shingles(t.as_py()) for t in batch.column(1)]
        flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])), pa.array(flat)], ["node", "token"])


def _class(size: Column) -> Column:
    return F.floor(F.log(size) * CLASSES).cast("int")


def _prefixes(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, n, component, rank, token, own, lo, hi): the rarest shingles of each text, one of which any similar text shares.

    ``nodes`` has (node, n, component), ``texts`` (node, text). Of texts of n and k shingles, similar ones share at least s = 4/9 (n + k),
    so one of the first n - s + 1 of the one and k - s + 1 of the other. A shingle goes to the classes of those sizes k for which it is
    among the first; ``lo`` and ``hi`` are the classes of the pair, ``own`` the text's.
    """
    tokens = stored(texts.join(nodes.select("node"), "node", "left_semi").select("node", "text").mapInArrow(_tokens, "node long, token long"), "similar-tokens", BATCH_ROWS)
    counts = tokens.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    shared = tokens.join(counts, "token").withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("held", "token"))).withColumn("m", F.count("*").over(Window.partitionBy("node")))
    # Shingles that no other text holds come first.
    ranked = shared.join(nodes, "node").withColumn("rank", F.col("n") - F.col("m") + F.col("at"))
    near, whole = SIMILARITY
    # s <= n - rank + 1 bounds k from above; the similarity itself bounds it from below.
    most = (F.col("n") - F.col("rank") + 1) * (near + whole) / near - F.col("n") + 1e-6
    least = F.greatest(F.col("n") * near / whole - 1e-6, F.lit(1.0))
    first = ranked.where(most >= least).select("node", "n", "component", "rank", "token", _class(F.col("n")).alias("own"), F.explode(F.sequence(_class(least), _class(F.least(most, F.col("n") * whole / near + 1e-6)))).alias("other"))
    first = stored(first.select("node", "n", "component", "rank", "token", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")), "similar-prefixes")
    met = first.groupBy("token", "lo", "hi").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("own").alias("a"), F.max("own").alias("b")).where("least <> most AND a = lo AND b = hi")
    first = stored(first.join(met.select("token", "lo", "hi"), ["token", "lo", "hi"]), "similar-met")
    discard(tokens)
    return first


def _prefix_pairs(first: DataFrame) -> DataFrame:
    """Distinct (a, b) of nodes of different components that share a prefix shingle and may be similar by its places."""
    near, whole = SIMILARITY
    one = first.where("own = lo").select("token", "lo", "hi", "node", "n", "rank", "component")
    two = first.where("own = hi").select("token", "lo", "hi", F.col("node").alias("m"), F.col("n").alias("k"), F.col("rank").alias("at"), F.col("component").alias("c"))
    shared = F.least(F.col("n") - F.col("rank"), F.col("k") - F.col("at")) + 1
    may = (shared * (near + whole) >= near * (F.col("n") + F.col("k"))) & (whole * F.least("n", "k") >= near * F.greatest("n", "k"))
    met = one.join(two, ["token", "lo", "hi"]).where((F.col("component") != F.col("c")) & may)
    return met.select(F.least("node", "m").alias("a"), F.greatest("node", "m").alias("b")).distinct()


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b of nodes that meet on a bucket, whose set sizes allow the similarity."""
    met = left.join(right.select("key", F.col("node").alias("m"), F.col("n").alias("k")), "key")
    met = met.where((F.col("node") != F.col("m")) & (SIMILARITY[1] * F.least("n", "k") >= SIMILARITY[0] * F.greatest("n", "k")))
    return met.select(F.least("node", "m").alias("a"), F.greatest("node", "m").alias("b")).distinct()


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes whose fingerprints lie within the radius of ``simhash``; nodes of one fingerprint meet its least."""
    prints = stored(nodes.groupBy("fp").agg(F.min("node").alias("least")), "similar-prints")
    near = simhash.links(prints.select("fp"))
    one, two = prints.select(F.col("fp").alias("a"), F.col("least").alias("x")), prints.select(F.col("fp").alias("b"), F.col("least").alias("y"))
    same = nodes.join(prints, "fp").where("node <> least").select(F.col("node").alias("x"), F.col("least").alias("y"))
    found = near.join(one, "a").join(two, "b").select("x", "y").union(same)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) by the links of similar nodes: of every node that has a link, and enough links to keep every connection.

    What prefixes link are the components of the links before, so only those meet again, not the nodes.
    ``nodes`` has (node, first, n, keys, fp), where ``first`` is a document of the node; ``texts`` has (id, text).
    """
    bands = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(bands.join(shared, "key"), "similar-members")
    close = stored(_fingerprint_pairs(nodes), "similar-close")
    wanted = members.select("node").union(close.select("a")).union(close.select("b")).distinct()
    wanted = nodes.select("node", F.col("first").alias("id")).join(wanted, "node")
    # Only the texts of candidates are read from here on.
    held = stored(texts.join(wanted, "id").select("node", "text"), "similar-texts")

    def verify(pairs: DataFrame, label: str) -> DataFrame:
        pairs = stored(pairs, f"similar-{label}-pairs")
        one = held.select(F.col("node").alias("a"), F.col("text").alias("s"))
        two = held.select(F.col("node").alias("b"), F.col("text").alias("t"))
        # The join on the greater end comes first, so that the rows of one lesser end lie together.
        rows = pairs.join(two, "b").join(one, "a").select("a", "b", "s", "t")
        found = stored(rows.mapInArrow(_verified, "a long, b long"), f"similar-{label}", BATCH_ROWS)
        discard(pairs)
        return found

    small = members.where(F.col("size") <= PAIR_CAP).select("key", "node", "n")
    large = members.where(F.col("size") > PAIR_CAP).select("key", "node", "n")
    least = large.groupBy("key").agg(*[F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node", "n")).alias(f"c{i}") for i in range(CENTRES)])
    centres = least.select("key", F.explode(F.array(*[f"c{i}" for i in range(CENTRES)])).alias("c")).select("key", "c.node", "c.n").distinct()
    found = verify(_pairs(small, small).union(_pairs(large, centres)).union(close).distinct(), "links")
    discard(close)
    parts = stored(connected_components(found, "similar-first"), "similar-parts")
    discard(found)
    if large.isEmpty():
        discard(members, held)
        return parts
    placed = large.join(parts.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    placed = stored(placed, "similar-placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    rest = stored(placed.join(mixed, "key").select("node", "n", "component").distinct(), "similar-rest")
    discard(members, placed)
    if rest.isEmpty():
        discard(held)
        return parts
    first = _prefixes(rest, held)
    more = verify(_prefix_pairs(first), "more-links")
    discard(first, held)
    if more.isEmpty():
        discard(more, rest)
        return parts
    one, two = rest.select(F.col("node").alias("a"), F.col("component").alias("x")), rest.select(F.col("node").alias("b"), F.col("component").alias("y"))
    joined = stored(more.join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "similar-joined")
    whole = connected_components(joined, "similar-whole").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    whole = stored(whole, "similar-whole")
    # Nodes without an earlier link are components of their own.
    alone = more.select(F.col("a").alias("node")).union(more.select(F.col("b").alias("node"))).distinct().join(parts, "node", "left_anti")
    every = parts.union(alone.select("node", F.col("node").alias("component")))
    every = stored(every.join(whole, "component", "left").select("node", F.coalesce("whole", "component").alias("component")), "similar-every")
    discard(more, rest, joined, whole, parts)
    return every


def _components(texts: DataFrame) -> DataFrame:
    """(id, node, component_id) for each row of ``texts`` (id, text)."""
    sketches = stored(texts.mapInArrow(_sketches, "id long, node long, n int, keys array<long>, fp long"), "similar-sketches")
    nodes = stored(sketches.groupBy("node").agg(F.min("id").alias("first"), *[F.first(c).alias(c) for c in ("n", "keys", "fp")]), "similar-nodes")
    parts = components(nodes, texts)
    named = nodes.select("node", "first").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(named, "similar-named")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.select("node", "component").join(smallest, "component").select("node", "component_id")
    found = stored(sketches.select("id", "node").join(ids, "node").select("id", "node", "component_id"), "similar-found")
    discard(parts, nodes, sketches, named)
    return found


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, component_id) for each (id, text) with an id; the component's smallest id names it."""
    rows = Rows(docs, id_col, text_col, "similar")
    return rows.with_ids(_components(rows.texts), "id", "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and one document (the smallest) of each component; null ids stay."""
    rows = Rows(docs, id_col, text_col, "similar")
    return rows.without(_components(rows.texts).where("id <> component_id").select("id"))
