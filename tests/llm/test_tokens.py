"""Byte BPE, token files and packing against the public libraries."""

import functools
import hashlib
import struct
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotewright.llm import bpe, chunked_tokenizer, packing, token_files

RANKS, BYTES, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@functools.cache
def tiktoken_encoding():
    with open(RANKS, "rb") as f:
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})


@pytest.fixture(scope="module")
def reference():
    return tiktoken_encoding()


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


odd = st.lists(st.sampled_from([*"ab ,.'_\n\t \u0085\x1c\0\u00a0\u03011é²ßΣİ好", "'s", "  ", "the", "ing", ", ", ". ", ".\n", "U.S.", "!!,", "<|endoftext|>"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(odd, max_size=5))
def test_bpe_equals_library_on_odd_spaces(texts):
    ref, codec = tiktoken_encoding(), bpe.codec(RANKS, P.PATTERN)
    assert codec.encode(texts) == [ref.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_equal_whole_texts(path):
    ref = library(path)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(odd, max_size=5))
    def check(texts):
        packed = chunked_tokenizer.tokenizer(path).packed(texts)
        assert [list(struct.unpack(f"<{len(p) // 4}I", p)) for p in packed] == [ref(t) for t in texts]

    check()


@pytest.mark.parametrize("piece", [b"a" * 700, b"abab" * 300, bytes(range(256)), b"x"])
def test_long_pieces_merge_as_short_ones(reference, piece):
    merger = bpe.codec(RANKS, P.PATTERN).merger
    assert merger.merge_long(piece) == reference._core_bpe.encode_single_piece(piece)
    assert merger.merge([piece[:40]])[0] == struct.pack(f"<{len(merger.merge_long(piece[:40]))}I", *merger.merge_long(piece[:40]))


def test_encode_decode(docs, rows, none, reference):
    got = {(r.id, bytes(r.data)) for r in bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    assert got == {(i, (t or "").encode()) for i, t in rows}
    assert bpe.encode(none, RANKS, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.codec(RANKS, P.PATTERN).decode([10**6])


def test_round_trip_digests(docs, rows, reference):
    def sha(b):
        return hashlib.sha256(b).hexdigest()

    want = Counter()
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want[i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())] += 1
    assert Counter(map(tuple, bpe.round_trip_digests(docs, RANKS, P.PATTERN).collect())) == want


def test_token_files(spark, docs, rows, none, tmp_path):
    folder, ref = f"file://{tmp_path}/set", library(BYTES)
    token_files.write_token_files(docs, folder, BYTES)
    got = sorted(token_files.read_digests(spark, folder).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at, texts = 0, {}
    for i, t in rows:
        texts.setdefault(i, ref(t) + [0])
    for r in got:
        ids = texts[r.id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert token_files.read_document(spark, folder, 7) == [texts[7]] * 2
    assert token_files.read_document(spark, folder, 10**9) == []
    assert token_files.token_digests(none, BYTES).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 51])
def test_ranges(spark, n):
    bounds = [7 * i for i in range(n)]
    values = spark.range(-3, 7 * n + 10)
    got = {r.id: r.n for r in values.select("id", token_files._range_of(F.col("id"), bounds).alias("n")).collect()}
    assert got == {v: sum(b < v for b in bounds) for v in got}


def test_dictionary_must_match(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/set"
    token_files.write_token_files(docs.limit(5), folder, BYTES)
    spark.createDataFrame([("0" * 64, bytearray(b"12345678"))], "dict_sha256 string, data binary").write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(ValueError):
        token_files.read_dictionary(spark, folder)


def test_pack(docs, rows, none):
    ref, capacity = library(WORDS), 256
    got = packing.pack(docs, WORDS, capacity).collect()
    want = Counter()
    for i, t in rows:
        ids = ref(t) + [0]
        for p, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[i, p, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    assert len(by) <= 1.03 * sum(r.length for r in got) / capacity + 1
    assert packing.pack(none, WORDS, capacity).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=12))
def test_configurations_hold_the_histogram(histogram):
    configs = packing.configurations(histogram, 64)
    held = Counter()
    for config, whole in configs:
        assert whole > 0 and sum(n * k for n, k in config.items()) <= 64
        for n, k in config.items():
            held[n] += k * whole
    assert held == Counter(histogram)
    left, bins = sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True), []
    for n in left:  # first fit decreasing is within 11/9 of the best
        at = next((i for i, room in enumerate(bins) if room >= n), None)
        if at is None:
            bins.append(64 - n)
        else:
            bins[at] -= n
    assert sum(w for _, w in configs) <= 1.02 * len(bins) + 1


def test_sequences_come_from_the_linear_programme():
    """At a few thousand lengths the greedy rest is under 5 % of the sequences that hold more than one full piece, near the bound by volume."""
    import numpy as np

    rng = np.random.default_rng(4)
    for lengths in (np.minimum(np.exp(rng.normal(6, 1, 9000)).astype(int) + 1, 2048), np.minimum(np.exp(rng.normal(5, 1.6, 6000)).astype(int) + 1, 2048)):
        histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
        configs, rest = packing.solved(histogram, 2048)
        held = Counter()
        for config, whole in configs + rest:
            assert whole > 0 and sum(n * k for n, k in config.items()) <= 2048
            for n, k in config.items():
                held[n] += k * whole
        assert held == Counter(histogram)
        sequences = sum(w for _, w in configs + rest)
        assert sum(w for _, w in rest) <= 0.05 * (sequences - histogram.get(2048, 0))
        assert sequences <= 1.002 * -(-int(lengths.sum()) // 2048) + 1


def test_lengths_that_fit_badly():
    import numpy as np

    lengths = np.random.default_rng(4).integers(20, 2049, 6000)
    configs = packing.configurations({int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}, 2048)
    assert sum(w for _, w in configs) <= 1.02 * lengths.sum() / 2048


@pytest.mark.parametrize("counts", [(9, 9, 9), (2, 1, 1), (1, 3, 0)])
def test_pricing_is_the_best_knapsack(counts):
    import itertools

    import numpy as np

    lengths, values = np.array([3, 5, 7]), np.array([2.0, 4.0, 5.5])
    got = packing.best_configuration(lengths, np.array(counts), values, 17)
    assert all(k <= counts[lengths.tolist().index(n)] for n, k in got.items()) and sum(n * k for n, k in got.items()) <= 17
    ranges = [range(c + 1) for c in counts]
    best = max(sum(k * v for k, v in zip(ks, values, strict=True)) for ks in itertools.product(*ranges) if sum(k * n for k, n in zip(ks, lengths, strict=True)) <= 17)
    assert sum(k * dict(zip(lengths.tolist(), values.tolist(), strict=True))[n] for n, k in got.items()) == pytest.approx(best)
