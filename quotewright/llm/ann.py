"""Approximate nearest neighbours by cosine, with an adaptive dimension scan of probed lists.

Vectors are scaled to length one, turned by a fixed random rotation and dealt to the lists of a k-means fitted on a bounded
sample (``FIT_ROWS`` vectors, those with the smallest id hashes); every vector is indexed. A query probes its nearest
lists: as many as hold ``TARGET`` of the neighbours that sample vectors have in the sample, which is more than they need
among all vectors, as nearer neighbours lie in nearer lists. A list's vectors lie in blocks of columns; after each block a hypothesis test compares the distance estimated
from the columns read with the query's bound, and abandons candidates that are too far with high confidence. The
bound starts as the distance of the query's nearest sample vectors and shrinks as candidates are read. Survivors are
scored exactly, in double precision, on the original vectors.

Equal vectors are one candidate that carries its smallest ids, and equal queries are searched once, so a vector that
very many rows hold costs as much as one. Small lists are searched together, so a query's vector goes once to each group of lists that
it probes; large lists are split into blocks of rows and queries into blocks of queries.

Defined results: vectors that are null, zero, hold null or non-finite components, or are not of the most common length
(ties: the greater) take no part; rows with null ids neither; rows that repeat an id count as one when their vectors
are equal. A query's own id is never among its neighbours. Ties go to smaller ids. An empty table gives an empty
result. Only the id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

FIT_ROWS = 20_000
#: Sample vectors to a list at least.
LIST_ROWS = 4
#: Share of the sample's neighbours that the probed lists hold, measured on so many of its vectors, and the lists probed at least.
TARGET, TRIED, PROBES = 0.96, 512, 4
#: A query also probes until the lists hold this many times the neighbours asked for.
ENOUGH = 8
COLUMNS = 16
#: Confidence of the test: a candidate is abandoned when its estimated distance exceeds the bound by 1 + this / sqrt(columns read).
EPSILON = 1.6
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 1_024
ROWS_AT_ONCE, QUERIES_AT_ONCE = 1_024, 128
SEED = 42


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))[0]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means on the sample's unit vectors."""
    rng = np.random.default_rng(SEED)
    at = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(8):
        owner = (sample @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, owner, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), at)
    return at


def probes_for(sample: np.ndarray, centre: np.ndarray, owner: np.ndarray, k: int) -> int:
    """The least number of nearest lists that hold ``TARGET`` of the ``k`` nearest sample vectors of sample vectors."""
    if len(sample) <= k + 1:
        return len(centre)
    places = []
    for q in sample[:TRIED]:
        near = np.argsort(-(sample @ q), kind="stable")[1 : k + 1]
        order = np.empty(len(centre), np.int64)
        order[np.argsort(-(centre @ q), kind="stable")] = np.arange(len(centre))
        places.append(order[owner[near]])
    return max(PROBES, int(np.quantile(np.concatenate(places), TARGET, method="higher")) + 1)


def scan(queries: np.ndarray, bounds: np.ndarray, blocks: list[np.ndarray], wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(query places, candidate places) of the pairs that survive one list's scan.

    ``blocks`` hold the columns of unit vectors; ``bounds`` are squared distances (of unit vectors: 2 - 2 cosine), one
    for each query, and shrink to the ``wanted``-th distance found as rows are read.
    """
    dims, n = queries.shape[1], len(blocks[0])
    best = np.full((len(queries), wanted), np.inf)
    bounds = bounds.copy()
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, n, ROWS_AT_ONCE):
        q = x = past = None
        read = 0
        for block in blocks:
            rows, part = block[at : at + ROWS_AT_ONCE], queries[:, read : read + block.shape[1]]
            read += block.shape[1]
            if past is None:
                gap = (part**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1) - 2 * part @ rows.T
            else:
                gap = past + ((part[q] - rows[x]) ** 2).sum(axis=1)
            limit = bounds * (read / dims * (1 + EPSILON / np.sqrt(read)) ** 2 if read < dims else 1) + 1e-9
            if past is None:
                q, x = np.nonzero(gap <= limit[:, None])
                past = gap[q, x]
            else:
                stay = gap <= limit[q]
                q, x, past = q[stay], x[stay], gap[stay]
        kept.append((q, x + at, past))
        order = np.lexsort((past, q))
        q, past = q[order], past[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        few = nth < wanted
        found = np.full((len(queries), wanted), np.inf)
        found[q[few], nth[few]] = past[few]
        best = np.sort(np.hstack((best, found)), axis=1)[:, :wanted]
        bounds = np.minimum(bounds, best[:, -1])
    q, x, past = (np.concatenate([k[i] for k in kept]) for i in range(3))
    stay = past <= bounds[q] + 1e-9
    return q[stay], x[stay]


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row for which ``is_query`` (over column ``id``) holds.

    ``probes`` sets the number of lists probed, which otherwise follows from ``TARGET``.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = _valid(vectors, id_col, vector_col)
    sizes = valid.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if sizes is None:
        return empty
    dims = sizes["dims"]
    kind = valid.schema["v"].dataType.simpleString()
    rows = stored(valid.where(F.size("v") == dims).distinct(), "ann-rows")
    # The row-number filter is applied within each task before the shuffle, so a hot vector sends few rows.
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1)
    classes = stored(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-classes")
    chosen = classes.select(F.element_at("ids", 1).alias("id"), "v").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow().column("v").combine_chunks()
    sample = unit(np.asarray(chosen.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dims)) @ rotation(dims)
    total = classes.count()
    lists = int(np.clip(round(total**0.5), 1, max(1, len(sample) // LIST_ROWS)))
    centre = centroids(sample, lists)
    owner = (sample @ centre.T).argmax(axis=1)
    probes = probes or probes_for(sample, centre, owner, k)

    def turned(column) -> np.ndarray:
        return unit(np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dims)) @ rotation(dims)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                to = (turned(batch.column(0)) @ centre.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(to)], ["v", "ids", "list"])

    indexed = stored(classes.mapInArrow(assign, f"v {kind}, ids array<long>, list int"), "ann-index")
    # One number for each list: the number of lists is bounded.
    counts = np.zeros(lists, np.int64)
    for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect():
        counts[r["list"]] = r["n"]
    # Lists next to each other share a group up to ``BLOCK_ROWS`` rows.
    group, held = np.zeros(lists, np.int64), 0
    for i in range(lists):
        group[i] = group[i - 1] if i else 0
        if held and held + counts[i] > BLOCK_ROWS:
            group[i], held = group[i] + 1, 0
        held += counts[i]

    queries = rows.where(is_query)
    asked = stored(queries.groupBy("v").agg(F.min("id").alias("qkey")), "ann-asked")

    def route(batches):
        names, kinds = ["qkey", "group", "lists", "bound"], [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.float64()]
        for batch in batches:
            if not batch.num_rows:
                continue
            q = turned(batch.column(0))
            order = np.argsort(-(q @ centre.T), axis=1, kind="stable")
            out: list[list] = [[] for _ in names]
            for i, key in enumerate(batch.column(1).to_pylist()):
                within = np.cumsum(counts[order[i]])
                n = min(lists, max(probes, int(np.searchsorted(within, ENOUGH * (k + 1))) + 1))
                to = np.sort(order[i, :n])
                to = to[counts[to] > 0]
                near = sample[np.isin(owner, order[i, : max(1, n // 4)])]
                near = near if len(near) > k else sample
                gap = np.sort(2 - 2 * (near @ q[i]))
                # The sample holds real candidates, so its (k+1)-th distance bounds that of the whole; one is the query's own vector.
                bound = float(gap[k]) if len(gap) > k else 4.0
                groups, first = np.unique(group[to], return_index=True)
                for g, part in zip(groups.tolist(), np.split(to, first[1:]), strict=True):
                    for column, value in zip(out, (key, g, part.tolist(), bound), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    # The routes hold ids; vectors join them where they are read.
    routed = stored(asked.mapInArrow(route, "qkey long, group int, lists array<int>, bound double"), "ann-routed")
    load = {r["group"]: r["n"] for r in routed.groupBy("group").agg(F.count("*").alias("n")).collect()}
    size = np.bincount(group, counts).astype(np.int64)
    splits = [(i, int(group[i]), int(-(-size[group[i]] // BLOCK_ROWS)), int(-(-load[group[i]] // BLOCK_QUERIES))) for i in range(lists) if counts[i] and group[i] in load]
    table = spark.createDataFrame(splits, "list int, group int, row_blocks int, query_blocks int")
    left = indexed.join(F.broadcast(table), "list").select("group", "list", F.pmod(F.xxhash64(F.element_at("ids", 1)), "row_blocks").cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"), "v", "ids")
    parts = routed.join(F.broadcast(table.drop("list").distinct()), "group").join(asked, "qkey")
    right = parts.select("group", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("rb"), F.pmod(F.xxhash64("qkey", F.lit(1)), "query_blocks").cast("int").alias("qb"), "v", "qkey", "lists", "bound")

    def search(rows: pa.Table, asks: pa.Table) -> pa.Table:
        names, kinds = ["qkey", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        out: list[list] = [[], [], []]
        if rows.num_rows and asks.num_rows:
            plain = np.asarray(rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dims)
            norms = np.linalg.norm(plain, axis=1)
            turn = unit(plain) @ rotation(dims)
            blocks = [turn[:, a : a + COLUMNS] for a in range(0, dims, COLUMNS)]
            ids = rows.column("ids").to_pylist()
            own = np.asarray(asks.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dims)
            q = unit(own) @ rotation(dims)
            size, keys, bounds = np.linalg.norm(own, axis=1), asks.column("qkey").to_pylist(), asks.column("bound").to_numpy()
            home = rows.column("list").to_numpy()
            wanted = asks.column("lists").to_pylist()
            owner_of, list_of = np.repeat(np.arange(len(q)), [len(w) for w in wanted]), np.concatenate([np.array(w, np.int64) for w in wanted])
            for x in np.unique(home).tolist():
                here, who = np.flatnonzero(home == x), owner_of[list_of == x]
                mine = [np.ascontiguousarray(b[here]) for b in blocks]
                for at in range(0, len(who), QUERIES_AT_ONCE):
                    some = who[at : at + QUERIES_AT_ONCE]
                    to, place = scan(q[some], bounds[some], mine, k + 1)
                    to, place = some[to], here[place]
                    scores = np.einsum("ij,ij->i", plain[place], own[to]) / (norms[place] * size[to])
                    for i, c, s in zip(to.tolist(), place.tolist(), scores.tolist(), strict=True):
                        out[0] += [keys[i]] * len(ids[c])
                        out[1] += ids[c]
                        out[2] += [s] * len(ids[c])
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    found = left.groupBy("group", "rb", "qb").cogroup(right.groupBy("group", "rb", "qb")).applyInArrow(search, "qkey long, vec_id long, score double")
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    # One more than asked for: a query's own id is among them and goes.
    best = stored(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).select("qkey", "vec_id", "score"), "ann-best")
    keyed = stored(queries.join(asked, "v").select(F.col("id").alias("query_id"), "qkey"), "ann-queries")
    discard(classes, indexed, routed, asked, rows)
    mine = keyed.join(best, "qkey").where(F.col("vec_id") != F.col("query_id"))
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
