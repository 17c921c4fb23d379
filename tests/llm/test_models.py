"""Classifiers on held-out rows, neighbours against brute force, and the pipeline stage by stage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotewright.llm import ann, quality, toxicity

from .conftest import frame, prose

BAD = ["idiot", "scumbag", "worthless", "trashy"]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts, a quarter of them toxic and a third shouting junk, with labels for most."""
    rng, rows, labels = random.Random(3), [], []
    for i in range(700):
        text, toxic, good = prose(rng, rng.randint(20, 80)), int(rng.random() < 0.25), int(rng.random() < 0.67)
        if not good:
            text = rng.choice([" ".join(w.upper() + "!!" for w in text.split()), " | ".join(text.split()), " ".join([text.split()[0]] * 40)])
        if toxic:
            # After the junk is made, which would drop the words again.
            words = text.split(" ")
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s"]))
            text = " ".join(words)
        rows.append((i, text))
        if i % 10:
            labels.append((i, good, toxic))
    labels += [(None, 1, 1), (5, None, None), (10**6, 0, 1)]
    return rows, spark.createDataFrame(labels, LABELS), {i: (g, t) for i, g, t in labels}


def test_toxicity_on_held_out_rows(spark, corpus):
    rows, labels, known = corpus
    docs = frame(spark, rows)
    model = toxicity.fit(docs, labels, where=F.col("id") % 3 != 1)
    assert (np.diff(model.thresholds) > 0).all() and (model.weights > 0).all()
    got = {r.id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in known if i in got and i % 3 == 1 and known[i][1] is not None]
    right = sum(got[i].toxic == bool(known[i][1]) for i in held)
    assert right >= 0.97 * len(held)
    assert not any(got[i].toxic and not known[i][1] for i in held)
    for r in got.values():
        assert 0 <= r.expected_severity <= 2 and r.toxic == (r.severity >= 1) == (r.p_toxic >= 0.5)
    two = [r.expected_severity for i, r in got.items() if sum(w in rows[i][1].lower() for w in BAD) >= 2]
    one = [r.expected_severity for i, r in got.items() if sum(w in rows[i][1].lower() for w in BAD) == 1]
    assert np.mean(two) > np.mean(one)
    stay = toxicity.drop_toxic(docs, model)
    assert {r.doc_id for r in stay.collect()} == {i for i, r in got.items() if not r.toxic} and stay.columns == docs.columns


def test_toxicity_edges(spark, docs, rows, none):
    empty = toxicity.fit(docs, spark.createDataFrame([], LABELS))
    assert not any(r.toxic for r in toxicity.score(docs, empty).collect())
    assert toxicity.score(docs, empty).count() == len(rows) and toxicity.score(none, empty).count() == 0
    clean = toxicity.fit(docs, spark.createDataFrame([(i, 1, 0) for i in range(10)], LABELS))
    assert not any(r.toxic for r in toxicity.score(docs, clean).collect())


def test_toxicity_as_stated(spark, corpus):
    """Scores, from the model's weights and the words of a text alone; other endings of known beginnings are found."""
    import re

    import xxhash

    rows, labels, _ = corpus
    model = toxicity.fit(frame(spark, rows), labels)
    weight = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
    texts = [*rows, (9000, "An IDIOTESQUE remark, worthlessly put"), (9001, None), (9002, "12 _ 34")]
    got = {r.id: r for r in toxicity.score(frame(spark, texts), model).collect()}
    for i, text in texts:
        parts = set()
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            parts.add(xxhash.xxh32_intdigest(f"w:{word}") | 1)
            parts |= {xxhash.xxh32_intdigest(f"{n}:{word[:n]}") & ~1 for n in range(3, min(8, len(word)))}
        total = sum(weight.get(x, 0.0) for x in parts)
        p = [1 / (1 + np.exp(t - total)) for t in model.thresholds]
        assert got[i].p_toxic == pytest.approx(p[0]) and got[i].expected_severity == pytest.approx(sum(p))
        assert got[i].severity == sum(x >= 0.5 for x in p)
    assert got[9000].toxic and not got[9001].toxic


def test_cumulative_link_gradient():
    """The fit stops where no step along a weight or a threshold makes the penalised likelihood better."""
    rng = np.random.default_rng(2)
    bad, sample = np.array([3, 5, 7], np.uint32), []
    for _ in range(600):
        found = bad[rng.random(3) < 0.15]
        toxic = int(rng.random() < 1 / (1 + np.exp(2 - 3 * len(found))))
        sample.append((toxic, np.concatenate((found, rng.choice(np.arange(11, 60, 2), 4, replace=False))).astype(np.uint32)))
    model = toxicity.fit_grades(sample, 0.5)
    y = toxicity.grades(sample)

    def loss(thresholds, weights):
        total = 0.0
        for (_, ids), grade in zip(sample, y, strict=True):
            v = sum(weights.get(int(i), 0.0) for i in ids)
            c = [0.0, *[1 / (1 + np.exp(v - t)) for t in thresholds], 1.0]
            total -= np.log(max(c[grade + 1] - c[grade], 1e-12))
        return total + 0.5 * sum(weights.values())

    weights = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
    here = loss(model.thresholds, weights)
    assert set(weights) & {3, 5, 7} == {3, 5, 7}
    for i in weights:
        for step in (-0.3, 0.3):
            assert loss(model.thresholds, weights | {i: max(0.0, weights[i] + step)}) >= here - 0.05


def test_quality_as_stated(spark, corpus):
    """The update and the score, written out plainly over the same hashed features."""
    import re

    import xxhash

    rows, labels, _ = corpus
    rows = [(i, t) for i, t in rows if i < 120]
    docs = frame(spark, rows)
    texts = dict(rows)

    def inputs(text):
        tokens = [xxhash.xxh32_intdigest(t) for t in re.findall(r"\w+|[^\w\s]+", text)]
        pairs = [a * 0x9E3779B1 % 2**32 ^ b for a, b in zip(tokens, tokens[1:])]
        repeated = 1 - len(set(pairs)) / len(pairs) if pairs else 0.0
        found = {x >> 32 - quality.BITS for x in [*tokens, *(p * 0x85EBCA6B % 2**32 for p in pairs)]}
        out = {2**quality.BITS: 1.0, 2**quality.BITS + 1 + int(repeated * quality.REPEAT_STEPS): 1.0}
        return out | {x: 1 / max(1, len(found)) ** 0.5 for x in found}

    z: dict[int, float] = {}
    n: dict[int, float] = {}

    def weight(x):
        v = z.get(x, 0.0)
        return 0.0 if abs(v) <= quality.L1 else -(v - np.sign(v) * quality.L1) / ((quality.BETA + n[x] ** 0.5) / quality.ALPHA + quality.L2)

    sample = sorted((r.doc_id, int(r.quality)) for r in labels.collect() if r.doc_id in texts and r.quality is not None)
    order = np.random.default_rng(0)
    for _ in range(quality.EPOCHS):
        for at in order.permutation(len(sample)).tolist():
            i, label = sample[at]
            x = inputs(texts[i])
            w = {f: weight(f) for f in x}
            p = 1 / (1 + np.exp(-sum(w[f] * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - label) * v
                z[f] = z.get(f, 0.0) + g - ((n.get(f, 0.0) + g * g) ** 0.5 - n.get(f, 0.0) ** 0.5) / quality.ALPHA * w[f]
                n[f] = n.get(f, 0.0) + g * g
    for r in quality.score(docs, quality.fit(docs, labels)).collect():
        v = sum(weight(f) * v for f, v in inputs(texts[r.id]).items())
        assert r.score == pytest.approx(1 / (1 + np.exp(-v)), abs=1e-5)


def test_quality_on_held_out_rows(spark, corpus):
    rows, labels, known = corpus
    docs = frame(spark, rows)
    scored = quality.score(docs, quality.fit(docs, labels, where=~quality.held_out("id")))
    got = {r.id: (r.score, r.out) for r in scored.select("id", "score", quality.held_out("id").alias("out")).collect()}
    held = [i for i, (_, out) in got.items() if out and known.get(i, (None,))[0] is not None]
    import zlib

    assert all(got[i][1] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert sum((got[i][0] >= 0.5) == bool(known[i][0]) for i in held) >= 0.95 * len(held)


def test_quality_edges(spark, docs, rows, none):
    weights = quality.fit(docs, spark.createDataFrame([], LABELS))
    got = quality.score(docs, weights).collect()
    assert len(got) == len(rows) and all(r.score == 0.5 for r in got)
    assert quality.score(none, weights).count() == 0
    ones = quality.fit(docs, spark.createDataFrame([(i, 1, 0) for i in range(40)], LABELS))
    assert all(r.score > 0.5 for r in quality.score(docs, ones).collect())


def test_score_reads_whole_texts(spark):
    rng = random.Random(9)
    model = toxicity.Model(np.array([1.0, 2.0]), np.sort(np.frombuffer(toxicity._chunk_features("scumbag"), "<u4").astype(np.uint32)), np.full(5, 2.0))
    long = prose(rng, 30_000) + " scumbag"
    assert [r.toxic for r in toxicity.score(frame(spark, [(1, long)]), model).collect()] == [True]


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "v") for i, v in rows], "vec_id long, embedding array<float>, label int, id int, v string")


def brute(rows, k=5):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % 5 == 0:
            scores = sorted((-(good[q] @ x) / np.linalg.norm(good[q]) / np.linalg.norm(x), i) for i, x in good.items() if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("n", [1, 4, 60, 600])
def test_neighbours(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.standard_normal(8).round(3).tolist()) for i in range(n)]
    rows += [(n + j, rows[0][1]) for j in range(n // 3)]  # a hot vector
    rows += [(10_000, None), (10_005, [0.0] * 8), (10_010, [float("nan")] * 8), (10_015, [1.0] * 7), (10_020, [1.0, None] * 4), (None, [1.0] * 8), (10_025, [float("inf")] * 8), (0, rows[0][1])]
    got: dict[int, list] = {}
    for r in ann.nearest(vectors(spark, rows), F.col("id") % 5 == 0).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = brute(rows)
    assert {q for q, v in want.items() if v} == set(got)
    hits = total = 0
    for q, best in want.items():
        found = got.get(q, [])
        assert len(found) == len(best)
        total += len(best)
        hits += sum(abs(s - t) < 1e-9 and i == j for (i, s), (j, t) in zip(found, best, strict=True))
    assert hits >= 0.9 * total


def test_neighbours_with_partial_probing(spark, monkeypatch):
    """5,500 vectors around centres, of which far from all lists are probed, with several groups of lists and blocks of rows."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((60, 24))
    at = (centres[rng.integers(0, 60, 5500)] + 0.35 * rng.standard_normal((5500, 24))).round(4)
    probed = []
    found_probes = ann.probes_for
    monkeypatch.setattr(ann, "BLOCK_ROWS", 700)
    monkeypatch.setattr(ann, "probes_for", lambda *a: probed.append((found_probes(*a), len(a[1]))) or probed[-1][0])
    got: dict[int, list] = {}
    for r in ann.nearest(vectors(spark, list(enumerate(at.tolist()))), F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert probed[0][0] <= 0.3 * probed[0][1]
    u = at.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 5500, 50):
        s = u @ u[q]
        s[q] = -2
        best = np.lexsort((np.arange(5500), -s))[:5].tolist()
        assert len(got[q]) == 5 and all(abs(score - s[i]) < 1e-9 for i, score in got[q])
        hits += len({i for i, _ in got[q]} & set(best))
    assert hits >= 0.9 * 5 * 110


def test_no_vectors(spark):
    assert ann.nearest(vectors(spark, []), F.col("id") % 5 == 0).count() == 0
    assert ann.nearest(vectors(spark, [(1, None)]), F.col("id") % 5 == 0).count() == 0


def test_scan_abandons_but_keeps_the_near():
    rng = np.random.default_rng(0)
    x = ann.unit(rng.standard_normal((3000, 64)))
    q = ann.unit(x[:10] + 0.05 * rng.standard_normal((10, 64)))
    blocks = [np.ascontiguousarray(x[:, a : a + 16]) for a in range(0, 64, 16)]
    places, found = ann.scan(q, np.full(10, 4.0), blocks, 3)
    for i in range(10):
        best = set(np.argsort(-(x @ q[i]))[:3].tolist())
        assert i in found[places == i] and len(best & set(found[places == i].tolist())) >= 2


def test_pipeline(spark, tmp_path, corpus):
    import corpus_pipeline as pipeline

    rows, labels, known = corpus
    rng = random.Random(4)
    passage = prose(rng, 70)
    clean = [i for i in known if i is not None and i < 700 and known[i][1] == 0]
    more = [(1000 + j, rows[clean[0]][1]) for j in range(5)] + [(1100 + j, f"{prose(rng, 30)} {passage} {prose(rng, 30)}") for j in range(4)] + [(1200, None), (1201, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + more], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r.text for r in now.collect()})
    toxic = {i for i, (_, t) in known.items() if t and i is not None and i < 700}
    assert len(toxic & kept[0].keys()) <= 0.03 * len(toxic)
    assert 1004 in kept[1] and not {1000, 1001, 1002, 1003, clean[0]} & kept[1].keys()
    assert passage in kept[3][1100] and all(passage not in kept[3][i] for i in (1101, 1102, 1103))
    alone = [i for i in clean if known[i][0] == 1 and i != clean[0]]
    assert sum(kept[3].get(i) == rows[i][1] for i in alone) >= 0.97 * len(alone)
    packed = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(kept[3])
