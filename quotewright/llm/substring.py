"""Substring dedup by collinear chaining of shared k-mer seeds.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. Of every ``WINDOW`` successive ``K``-word k-mers the
one with the least hash is a seed, so any stretch of ``K + WINDOW - 1`` equal words in two documents yields a common
seed. A seed's anchor is its first place in the document with the smallest id; every place in another document is matched
with the anchor and never with all others, so matches grow with the places and not with their pairs. Where every seed of ``MIN_WORDS``
words has an anchor and yet no passage covers them, the anchors may hold fragments alone; such words meet once more as a whole, on the
hash of all ``MIN_WORDS`` of them, so of equal words the first place in the document with the smallest id is found. A document's matches
with one anchor document are chained with gap costs by a Fenwick tree, chains are cut at wide gaps, and each piece is
aligned word by word in both texts, between its seeds and outwards from its ends. A passage is reported when it has
``MIN_WORDS`` words or more and at least ``MIN_IDENTITY`` of the longer side's words align.

Defined results: null, empty and short texts have no passages; repeats within one document alone are not reported;
rows with null ids take no part and stay as they are. Rows that repeat an id with different texts are documents of their own, the
one with the lesser text hash being the first; rows that repeat id and text are one document. The smallest id holds
the first copy, and a passage may be reported with more than one anchor document. An empty table gives an empty result. Only
the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkCache, Rows, discard, stored

K = 6
WINDOW = 20
MIN_WORDS = 50
MIN_IDENTITY = 0.8
#: Gap cost of a chain for each word skipped on either side, against ``K`` for each seed.
GAP_COST = 0.1
#: Chains are cut where two seeds lie further apart than this on either side.
MAX_GAP = 40
#: Words beyond a piece's ends that alignment may take in.
REACH = 96
#: Anchors hand out their words in stretches that begin and end at multiples of this, to so many parts of the pieces that ask for one.
TILE, PARTS = 256, 64
#: Rows with texts that Python gets at a time.
BATCH_ROWS = 1_000
#: Words whose hashes a worker remembers; a hash costs little more than a look-up.
CACHE_WORDS = 100_000
#: Outward alignment passes a mismatch if this many words agree again within so few skipped words.
RESYNC, SKIP = 4, 4

_word = re.compile(r"[^\x20\x09-\x0D]+")
_cache: list[ChunkCache] = []


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams_of(words: list[bytes], k: int):
    """The hash of each ``k`` successive words."""
    import numpy as np
    import xxhash

    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if not _cache:
        _cache.append(ChunkCache(lambda w: xxhash.xxh64_digest(w), CACHE_WORDS))
    own = np.frombuffer(_cache[0].gather(words), "<u8")
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + own[j : j + n]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    return grams


def least_of(kmers, width: int):
    """The place of the least (of equal ones the first) of each ``width`` successive hashes."""
    import numpy as np

    windows = np.lib.stride_tricks.sliding_window_view(kmers, width)
    picked = np.empty(len(windows), np.int64)
    for a in range(0, len(windows), 65_536):
        picked[a : a + 65_536] = windows[a : a + 65_536].argmin(axis=1) + np.arange(a, min(a + 65_536, len(windows)))
    return picked


def seeds_of(words: list[bytes]):
    """(hashes, places) of the document's seeds."""
    import numpy as np

    kmers = grams_of(words, K)
    n = len(kmers)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= WINDOW:
        at = np.array([int(kmers.argmin())])
    else:
        picked = least_of(kmers, WINDOW)
        at = picked[np.concatenate(([True], picked[1:] != picked[:-1]))]
        # In a run of overlapping equal k-mers one in ``WINDOW`` words stands for the others: alignment reads on from it.
        run = np.concatenate(([False], (kmers[at[1:]] == kmers[at[:-1]]) & (at[1:] - at[:-1] < K)))
        step = (at - at[~run][np.cumsum(~run) - 1]) // WINDOW
        at = at[~run | np.concatenate(([False], step[1:] != step[:-1]))]
    return kmers[at].view(np.int64), at


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a in range(0, batch.num_rows, 512):
            found = [seeds_of(words_of(t.as_py())) for t in batch.column(1)[a : a + 512]]
            owner = np.repeat(ids[a : a + 512], [len(p) for _, p in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for h, _ in found])), pa.array(owner), pa.array(np.concatenate([p for _, p in found]).astype(np.int32))], ["seed", "id", "pos"])


def chains(matches: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Best collinear chains of (anchor place, own place) matches, each match in one chain at most.

    The score of a chain is ``K`` a seed less the gap costs. The best predecessor of a match is a prefix maximum over
    own places of score plus place costs, which a Fenwick tree keeps while matches come in anchor order.
    """
    matches = sorted(set(matches), key=lambda m: (m[0], -m[1]))
    rank = {p: r for r, p in enumerate(sorted({p for _, p in matches}), 1)}
    size = len(rank)
    tree: list[tuple[float, int]] = [(0.0, -1)] * (size + 1)
    scores, back = [], []
    for at, (a, p) in enumerate(matches):
        place = GAP_COST * (a + p)
        best, before = (float("-inf"), -1)
        r = rank[p] - 1
        while r > 0:
            if tree[r][1] >= 0 and tree[r][0] > best:
                best, before = tree[r]
            r &= r - 1
        if before >= 0 and best - place + GAP_COST * 2 * K > 0:
            scores.append(K + best - place + GAP_COST * 2 * K)
            back.append(before)
        else:
            scores.append(float(K))
            back.append(-1)
        value, r = scores[at] + place, rank[p]
        while r <= size:
            if tree[r][1] < 0 or tree[r][0] < value:
                tree[r] = (value, at)
            r += r & -r
    out, used = [], [False] * len(matches)
    for end in sorted(range(len(matches)), key=lambda i: -scores[i]):
        chain, at = [], end
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(matches[at])
            at = back[at]
        if chain:
            out.append(chain[::-1])
    return out


def pieces_of(chain: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The chain, cut where its seeds lie further apart than ``MAX_GAP``."""
    out = [[chain[0]]]
    for (a, p), (b, q) in pairwise(chain):
        if b - a > MAX_GAP + K or q - p > MAX_GAP + K:
            out.append([])
        out[-1].append((b, q))
    return out


def _inside(spans: list[dict] | None) -> Callable:
    """Tells of words from first up to last (arrays) whether they lie in one of the spans."""
    import numpy as np

    ends = sorted((x["start"], x["end"]) for x in spans or [])
    starts, stops = np.array([x[0] for x in ends], np.int64), np.maximum.accumulate(np.array([x[1] for x in ends], np.int64))

    def inside(first, last):
        at = np.searchsorted(starts, first, "right") - 1
        return (at >= 0) & (last <= stops[np.maximum(at, 0)]) if len(starts) else np.zeros(len(first), bool)

    return inside


def _unclear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds of ``MIN_WORDS`` successive words that have anchors for all their seeds and lie in no passage."""
    import numpy as np

    span = MIN_WORDS - K + 1
    for batch in batches:
        wanted = set()
        for text, found, spans in zip(*(batch.column(c) for c in range(3)), strict=True):
            own = np.array(sorted({m["pos"] for m in found.as_py()}), np.int64)
            inside = _inside(spans.as_py())
            # Such words hold two seeds next to each other; most documents have none outside of passages and are not read.
            near = own[1:] - own[:-1] < WINDOW + K
            if not (near & ~inside(np.maximum(own[1:] - span + 1, 0), own[:-1] + MIN_WORDS)).any():
                continue
            words = words_of(text.as_py())
            kmers = grams_of(words, K)
            if len(kmers) < span:
                continue
            shared = np.isin(kmers[least_of(kmers, WINDOW)], np.unique(kmers[own[own < len(kmers)]]))
            lone = np.concatenate(([0], np.cumsum(~shared)))
            first = np.arange(len(words) - MIN_WORDS + 1)
            # All windows within the words have a shared seed.
            open_at = first[(lone[first + span - WINDOW + 1] == lone[first]) & ~inside(first, first + MIN_WORDS)]
            if len(open_at):
                wanted.update(kmers[least_of(kmers, span)[open_at]].view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(wanted), pa.int64())], ["seed"])


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, id, at) of all ``MIN_WORDS`` successive words whose least k-mer is one of the given seeds."""
    import numpy as np

    for batch in batches:
        hashes, owners, places = [np.zeros(0, np.int64)], [], []
        for text, seeds in zip(batch.column(1), batch.column(2), strict=True):
            words = words_of(text.as_py())
            grams, kmers = grams_of(words, MIN_WORDS), grams_of(words, K)
            at = np.flatnonzero(np.isin(kmers[least_of(kmers, MIN_WORDS - K + 1)].view(np.int64), np.array(seeds.as_py(), np.int64))) if len(grams) else np.zeros(0, np.int64)
            hashes.append(grams[at].view(np.int64))
            owners.append(len(at))
            places.append(at.astype(np.int32))
        owner = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), owners)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(owner), pa.array(np.concatenate([np.zeros(0, np.int32), *places]))], ["gram", "id", "at"])


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, found): of the matches of ``MIN_WORDS`` words outside of passages, those that alignment does not reach from the one before of the same shift."""
    import numpy as np

    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("apos", pa.int32()), ("pos", pa.int32())]))
    for batch in batches:
        ids, needed = [], []
        for i, found, spans in zip(*(batch.column(c) for c in range(3)), strict=True):
            matches = sorted(found.as_py(), key=lambda m: m["pos"])
            first = np.array([m["pos"] for m in matches], np.int64)
            kept, last = [], {}
            for m, covered in zip(matches, _inside(spans.as_py())(first, first + MIN_WORDS).tolist(), strict=True):
                shift = m["anchor"], m["pos"] - m["apos"]
                if not covered and m["pos"] - last.get(shift, -REACH) > REACH - MIN_WORDS:
                    last[shift] = m["pos"]
                    kept.append(m)
            if kept:
                ids.append(i.as_py())
                needed.append(kept)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(needed, kind)], ["id", "found"])


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_chained`` with a piece for each match."""
    return _chained(batches, lambda matches: [[m] for m in matches])


def _chained(batches: Iterator[pa.RecordBatch], chains: Callable[[list], list] = chains) -> Iterator[pa.RecordBatch]:
    """One row for each piece: own words around it, its seeds as distances from its first, and the anchor's words that alignment may read."""
    names = ["id", "anchor", "own_first", "own_at", "anchor_at", "words", "seeds", "lo", "hi"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.int32()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        held = 0
        for i, text, found in zip(*(batch.column(c) for c in range(3)), strict=True):
            words = words_of(text.as_py())
            by_anchor: dict[int, list[tuple[int, int]]] = {}
            for m in found.as_py():
                by_anchor.setdefault(m["anchor"], []).append((m["apos"], m["pos"]))
            for anchor, matches in by_anchor.items():
                for chain in chains(matches):
                    for piece in pieces_of(chain):
                        (a, p), (b, last) = piece[0], piece[-1]
                        if last >= len(words):
                            continue
                        first = max(0, p - REACH)
                        row = (i.as_py(), anchor, first, p, a, b" ".join(words[first : last + K + REACH]), [x for c, q in piece for x in (c - a, q - p)], max(0, a - REACH) // TILE * TILE, -(-(b + K + 2 * REACH) // TILE) * TILE)
                        held += len(row[5])
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            if held > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                out, held = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def _outwards(x: list[bytes], y: list[bytes]) -> tuple[int, int, int]:
    """(words taken of x, of y, words equal) of an alignment from the start of both, ending on an equal word."""
    i = j = equal = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j, equal = i + 1, j + 1, equal + 1
            continue
        for skip in range(1, 2 * SKIP + 1):
            jump = next(((s, skip - s) for s in sorted(range(max(0, skip - SKIP), min(SKIP, skip) + 1), key=lambda s, k=skip: abs(2 * s - k)) if len(x[i + s : i + s + RESYNC]) == RESYNC and x[i + s : i + s + RESYNC] == y[j + skip - s : j + skip - s + RESYNC]), None)
            if jump:
                break
        else:
            break
        i, j = i + jump[0], j + jump[1]
    return i, j, equal


def _common(x: list[bytes], y: list[bytes]) -> int:
    """Length of the longest common subsequence of two short lists."""
    row = [0] * (len(y) + 1)
    for a in x:
        before = 0
        for j, b in enumerate(y, 1):
            before, row[j] = row[j], before + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]


def align(own: list[bytes], at: int, anchor: list[bytes], anchor_at: int, seeds: list[tuple[int, int]]) -> tuple[int, int, int, int, int] | None:
    """(own start, own end, anchor start, anchor end, equal words) of a piece, or None where its first seed is not in both.

    ``seeds`` are (anchor, own) distances from the first seed's places.
    """
    if not own[at : at + K] or own[at : at + K] != anchor[anchor_at : anchor_at + K]:
        return None
    i, j, equal = at, anchor_at, 0
    for b, q in seeds:
        p, a = at + q, anchor_at + b
        if p < i or a < j:
            # Overlaps what is aligned: on the same diagonal read on, else leave the seed out.
            if p - i != a - j:
                continue
            while i < p + K and j < len(anchor) and i < len(own) and own[i] == anchor[j]:
                i, j, equal = i + 1, j + 1, equal + 1
            continue
        if own[p : p + K] != anchor[a : a + K]:
            continue
        equal += p - i if own[i:p] == anchor[j:a] else _common(own[i:p], anchor[j:a])
        i, j, equal = p + K, a + K, equal + K
    right, across, more = _outwards(own[i : i + REACH], anchor[j : j + REACH])
    left, back, less = _outwards(own[max(0, at - REACH) : at][::-1], anchor[max(0, anchor_at - REACH) : anchor_at][::-1])
    return at - left, i + right, anchor_at - back, j + across, equal + more + less


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, lo, hi, parts, there): the words of anchors that were asked for."""
    names = ["anchor", "lo", "hi", "parts", "there"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        held = 0
        for anchor, text, asked in zip(*(batch.column(c) for c in range(3)), strict=True):
            words = words_of(text.as_py())
            for x in asked.as_py():
                row = (anchor.as_py(), x["lo"], x["hi"], x["parts"], b" ".join(words[x["lo"] : x["hi"]]))
                held += len(row[4])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            if held > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                out, held = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "start", "end", "anchor", "anchor_start", "anchor_end", "equal_words"]
    last, words = None, []
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for r in range(batch.num_rows):
            i, anchor, first, at, a, own, seeds, lo, there = (batch.column(c)[r] for c in range(9))
            lo, key = lo.as_py(), there.as_buffer()
            if last is None or not key.equals(last):
                last, words = key, there.as_py().split()
            flat = seeds.as_py()
            got = align(own.as_py().split(), at.as_py() - first.as_py(), words, a.as_py() - lo, list(zip(flat[::2], flat[1::2], strict=True)))
            if got is None:
                continue
            start, end, b, c, equal = got
            if end - start >= MIN_WORDS and equal >= MIN_IDENTITY * max(end - start, c - b):
                for column, value in zip(out, (i.as_py(), start + first.as_py(), end + first.as_py(), anchor.as_py(), b + lo, c + lo, equal), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("id", "anchor") else pa.int32()) for n, c in zip(names, out, strict=True)], names)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, anchor, anchor_start, anchor_end, equal_words): passages, in word places, whose first copy another document holds."""
    rows = Rows(docs, id_col, text_col, "substring")
    return rows.with_ids(_all_passages(rows.texts), "id", "anchor")


def _all_passages(rows: DataFrame) -> DataFrame:
    """The passages of ``rows`` (id, text), of which ids do not repeat; written."""
    texts = rows.where("text IS NOT NULL")
    seeds = stored(texts.mapInArrow(_seeds, "seed long, id long, pos int"), "substring-seeds", BATCH_ROWS)
    firsts = seeds.groupBy("seed").agg(F.min(F.struct("id", "pos")).alias("first"), F.max("id").alias("last")).where("first.id < last")
    firsts = stored(firsts.select("seed", F.col("first.id").alias("anchor"), F.col("first.pos").alias("apos")), "substring-anchors")
    matches = seeds.join(firsts, "seed").where("id <> anchor").select("id", F.struct("anchor", "apos", "pos").alias("m"))
    # A document's matches are no more than its own seeds.
    found = stored(matches.groupBy("id").agg(F.collect_list("m").alias("found")), "substring-matches")
    discard(firsts)
    passages = _passages(texts, found, _chained)
    spans = passages.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    unclear = texts.join(found, "id").join(spans, "id", "left").select("text", "found", "spans").mapInArrow(_unclear, "seed long")
    unclear = stored(unclear.distinct(), "substring-unclear", BATCH_ROWS)
    discard(found)
    if unclear.isEmpty():
        discard(seeds, unclear)
        return passages
    held = seeds.join(unclear, "seed").groupBy("id").agg(F.collect_set("seed").alias("held"))
    grams = stored(texts.join(held, "id").select("id", "text", "held").mapInArrow(_wholes, "gram long, id long, at int"), "substring-wholes", BATCH_ROWS)
    discard(seeds, unclear)
    firsts = grams.groupBy("gram").agg(F.min(F.struct("id", "at")).alias("first"), F.max("id").alias("last")).where("first.id < last")
    firsts = stored(firsts.select("gram", F.col("first.id").alias("anchor"), F.col("first.at").alias("apos")), "substring-first-wholes")
    equal = grams.join(firsts, "gram").where("id <> anchor").select("id", F.struct("anchor", "apos", F.col("at").alias("pos")).alias("m"))
    # A document's matches are no more than its own words.
    equal = equal.groupBy("id").agg(F.collect_list("m").alias("found")).join(spans, "id", "left").select("id", "found", "spans")
    found = stored(equal.mapInArrow(_needed, "id long, found array<struct<anchor: long, apos: int, pos: int>>"), "substring-more-matches", BATCH_ROWS)
    discard(grams, firsts)
    more = _passages(texts, found, _single)
    both = stored(passages.union(more).distinct(), "substring-all-passages")
    discard(found, passages, more)
    return both


def _passages(texts: DataFrame, found: DataFrame, pieces: Callable) -> DataFrame:
    """The passages that documents' matches give, as pieces of chains or one by one; written.

    A piece meets the words of its anchor that alignment may read and not the whole text. Pieces that ask for the same words are dealt
    over ``PARTS`` by their own ids, so a passage that very many documents share is not aligned in one task.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("part")
    chained = texts.join(found, "id").select("id", "text", "found").mapInArrow(pieces, "id long, anchor long, own_first int, own_at int, anchor_at int, words binary, seeds array<int>, lo int, hi int")
    chained = stored(chained, "substring-pieces", BATCH_ROWS)
    asked = chained.select("anchor", "lo", "hi", part).distinct().groupBy("anchor", "lo", "hi").agg(F.collect_list("part").alias("parts"))
    # Stretches are bounded by the anchor's own length.
    asked = asked.groupBy("anchor").agg(F.collect_list(F.struct("lo", "hi", "parts")).alias("asked"))
    there = texts.withColumnRenamed("id", "anchor").join(asked, "anchor").select("anchor", "text", "asked")
    there = stored(there.mapInArrow(_stretches, "anchor long, lo int, hi int, parts array<int>, there binary"), "substring-stretches", BATCH_ROWS)
    there = there.select("anchor", "lo", "hi", F.explode("parts").alias("part"), "there")
    both = chained.withColumn("part", part).join(there, ["anchor", "lo", "hi", "part"])
    both = both.select("id", "anchor", "own_first", "own_at", "anchor_at", "words", "seeds", "lo", "there")
    aligned = both.mapInArrow(_aligned, "id long, start int, end int, anchor long, anchor_start int, anchor_end int, equal_words int")
    passages = stored(aligned.distinct(), "substring-passages", BATCH_ROWS)
    discard(chained)
    return passages


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with all its columns, where repeated passages are cut out of the texts, the first copy staying.

    A document of which nothing but white space is left goes. ``length_col`` is set to the new number of characters of
    the documents that were cut.
    """
    rows = Rows(docs, id_col, text_col, "substring")
    spans = _all_passages(rows.texts).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    names = docs.columns

    def cut(batches):
        for batch in batches:
            columns, spans = dict(zip(names, batch.column(0).flatten(), strict=True)), batch.column(1).to_pylist()
            texts = columns[text_col].to_pylist()
            new = [_without(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            stay = pa.array([not s or bool(t.strip()) for t, s in zip(new, spans, strict=True)], pa.bool_())
            columns[text_col] = pa.array(new, columns[text_col].type)
            if length_col in columns:
                old = columns[length_col]
                columns[length_col] = pa.array([len(t) if s else n for t, s, n in zip(new, spans, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(stay)

    return rows.joined(spans).mapInArrow(cut, docs.schema)


def _without(text: str, spans: list[dict]) -> str:
    """The text without the words in the spans and the space that follows each span."""
    places = [m.span() for m in _word.finditer(text)]
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["start"] >= len(places):
            continue
        out.append(text[at : max(at, places[s["start"]][0])])
        at = max(at, places[s["end"]][0] if s["end"] < len(places) else len(text))
    return "".join(out) + text[at:]
