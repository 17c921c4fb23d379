"""Exact, SimHash and substring dedup, and sharding, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quotewright.llm import common, exact_dedup, sharding, simhash, substring

from .conftest import frame, prose


def lower(t):
    return (t or "").encode().lower()


def test_exact(docs, rows, none):
    groups: dict[bytes, list] = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = Counter()
    for i, t in rows:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        want[i, keep, len(g), i == keep, hashlib.sha256(lower(t)).hexdigest()] += 1
    got = exact_dedup.exact_duplicates(docs, extra={"sha": F.sha2("norm", 256)})
    assert Counter(map(tuple, got.collect())) == want
    assert exact_dedup.exact_duplicates(none).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {max((x for x in g if x is not None), default=None) for g in groups.values()}


def test_exact_shuffles_when_keys_are_many(docs, monkeypatch):
    want = sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect()), key=str)
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 0)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect()), key=str) == want


def fingerprint(t):
    words = lower(t).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values):
    """Smallest index reachable over links of three or fewer bits."""
    owner = list(range(len(values)))

    def find(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                owner[b] = a
    return [find(i) for i in range(len(values))]


def test_simhash(docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    known = sorted({i: t for i, t in rows if i is not None}.items())
    prints = [fingerprint(t) for _, t in known]
    want = {i: (f, known[c][0]) for (i, _), f, c in zip(known, prints, components(prints), strict=True)}
    assert len(got) == len(rows)
    for r in got:
        if r.id is None:
            assert r.component_id is None
        else:
            assert (r.fp % (1 << 64), r.component_id) == want[r.id]
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("cap", [0, 2, 10_000])
def test_links_keep_components_whatever_the_cap(spark, monkeypatch, cap):
    """A dense cloud around a few centres: pairs up to the cap and balls beyond it connect the same."""
    monkeypatch.setattr(simhash, "PAIR_CAP", cap)
    rng = random.Random(1)
    values = set()
    for centre in (rng.getrandbits(64) for _ in range(4)):
        for _ in range(60):
            v = centre
            for _ in range(rng.randint(0, 6)):
                v ^= 1 << rng.choice([0, 1, 2, 3, 5, 8, 30, 31, 32, 33, 40, 62, 63])
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    place = {v: i for i, v in enumerate(signed)}
    owner = list(range(len(values)))

    def find(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for r in edges.collect():
        assert (r.a ^ r.b).bit_count() <= 3 if r.a >= 0 and r.b >= 0 else ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 3
        a, b = sorted((find(place[r.a]), find(place[r.b])))
        owner[b] = a
    assert [find(i) for i in range(len(values))] == components(values)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, x) for x in range(501, 560)] + [(7, 7), (None, 3), (900, 901), (901, 902), (902, 900)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{x: 500 for x in range(500, 560)}, 7: 7, 900: 900, 901: 900, 902: 900}


def test_passages(docs, rows, none):
    got = substring.repeated_passages(docs).collect()
    words = {}
    for i, t in rows:
        words.setdefault(i, substring.words_of(t))
    covered: dict[int, set] = {}
    for r in got:
        assert r.anchor < r.id and r.end - r.start >= substring.MIN_WORDS
        assert r.equal_words >= substring.MIN_IDENTITY * max(r.end - r.start, r.anchor_end - r.anchor_start)
        assert r.end <= len(words[r.id]) and r.anchor_end <= len(words[r.anchor])
        covered.setdefault(r.id, set()).update(range(r.start, r.end))
    first: dict[bytes, int] = {}
    for i in sorted(k for k in words if k is not None):
        seen = set()
        for at in range(len(words[i]) - 49):
            gram = b" ".join(words[i][at : at + 50])
            if gram in first and first[gram] != i:
                seen.update(range(at, at + 50))
            else:
                first.setdefault(gram, i)
        assert seen <= covered.get(i, set()), i
    # The edited copy of the passage is found across its change and its insertion.
    edited = next(i for i, t in rows if t and " inserted " in t)
    assert len(covered[edited]) >= 65
    clean = {i for i, _ in rows[:40]} - {3, 4}
    assert not clean & covered.keys()
    assert substring.repeated_passages(none).count() == 0


def test_cut(docs, rows, none):
    got = {r.doc_id: r for r in substring.cut_passages(docs, length_col="n_chars").collect()}
    texts = dict(rows)
    assert got[3].text == texts[3] and got[0].n_chars == len(texts[0])
    if len(substring.words_of(texts[3])) >= 50:
        assert 40 not in got
    shared = [i for i, _ in rows[51:57]]
    assert got[shared[0]].text == texts[shared[0]]
    for i in shared[1:]:
        assert len(got[i].text) < len(texts[i]) and got[i].n_chars == len(got[i].text)
        assert got[i].text.split()[:25] == texts[i].split()[:25]
    assert None in got and substring.cut_passages(none).count() == 0


def test_chains_take_the_best_order():
    matches = [(i * 10, 100 + i * 10) for i in range(8)] + [(35, 20), (36, 300), (75, 5)]
    best = max(substring.chains(matches), key=len)
    assert best == [(i * 10, 100 + i * 10) for i in range(8)]
    assert len(substring.pieces_of([(0, 0), (10, 10), (500, 20)])) == 2


def test_hot_passage_stays_linear(spark):
    rng = random.Random(2)
    passage = prose(rng, 60)
    many = [(i, f"{prose(rng, 12)} {passage} {prose(rng, 12)}") for i in range(300)]
    got = substring.repeated_passages(frame(spark, many, 5)).collect()
    assert {r.id for r in got} == set(range(1, 300)) and len(got) <= 2 * 300


def best_capacity(sizes, shards):
    def fits(c):
        used, held = 1, 0
        for s in sizes:
            if s > c:
                return False
            if held + s > c:
                used, held = used + 1, 0
            held += s
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("case", range(5))
def test_capacity_is_minimal(spark, case):
    rng = random.Random(case)
    n = [3, 40, 9000, 9000, 8][case]
    groups = sorted((hashlib.sha256(f"{case} {i}".encode()).hexdigest(), rng.choice([1, 5, 100, rng.randint(1, 3000)])) for i in range(n))
    if case in (3, 4):
        groups[n // 3] = (groups[n // 3][0], sum(s for _, s in groups) // 2)
    starts = sharding.shard_starts(spark.createDataFrame(groups, "key string, size long"), 8)
    totals = [0] * 8
    for key, size in groups:
        totals[sum(key >= s for s in starts)] += size
    assert max(totals) == best_capacity([s for _, s in groups], 8)


def test_shards(docs, rows, none):
    got = sharding.shard_documents(docs, 4).collect()
    assert Counter((r.id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    texts, shard = {}, {}
    for i, t in rows:
        texts[i] = t or ""
    for r in got:
        assert shard.setdefault(texts[r.id], r.shard) == r.shard and 0 <= r.shard < 4
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    sizes: dict[str, int] = {}
    for r in got:
        k = hashlib.sha256(texts[r.id].encode()).hexdigest()
        sizes[k] = sizes.get(k, 0) + r.size
    assert max(sum(r.size for r in got if r.shard == s) for s in range(4)) == best_capacity([sizes[k] for k in sorted(sizes)], 4)
    assert sharding.shard_documents(none, 4).count() == 0
