"""Rows that repeat an id: another text under the same id is a document of its own, and no row is lost or kept twice."""

import random
from collections import Counter

import pytest

from quotewright.llm import exact_dedup, similar, substring

from .conftest import prose
from .test_similar import shingle_set

SCHEMA = "doc_id long, text string, __spans string, row string, k string, i int, key string, count int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(23)
    a, b, c, passage = (prose(rng, 90) for _ in range(4))
    return {"a": a, "b": b, "c": c, "passage": passage, "near": a + " more"}


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", "r", "k", 1, "y", 2) for i, t in rows], SCHEMA).repartition(3)


def lower(t):
    return (t or "").encode().lower()


def shout(t):
    return t.encode().upper().decode()


def rows_of(texts):
    a, b, c, near = (texts[k] for k in ("a", "b", "c", "near"))
    return [(5, a), (9, shout(a)), (5, b), (1, a), (5, b), (5, shout(b)), (7, c), (7, c), (8, near), (5, ""), (5, None), (None, c), (None, "alone"), (None, "alone")]


def test_exact(spark, texts):
    rows = rows_of(texts)
    docs = table(spark, rows)
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = Counter((max((i for i in g if i is not None), default=None), t) for t, g in groups.items())
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.schema == docs.schema
    assert Counter((r.doc_id, lower(r.text)) for r in kept.collect()) == want
    plain = [(i, t) for i, t in rows if i not in (7, None) and lower(t) != lower(texts["b"])]
    assert Counter((r.doc_id, lower(r.text)) for r in exact_dedup.drop_exact_duplicates(table(spark, plain)).collect()) == Counter((i, t) for i, t in want if i not in (7, None) and t != lower(texts["b"]))


def test_near(spark, texts):
    rows = rows_of(texts)
    docs = table(spark, rows)
    left = [r for r in rows if r[0] is not None]
    groups: list[list] = []
    for i, t in left:
        own = shingle_set(t)
        met = [g for g in groups if any(5 * len(own & shingle_set(u)) >= 4 * len(own | shingle_set(u)) for _, u in g)]
        groups = [g for g in groups if g not in met] + [[(i, t), *(x for g in met for x in g)]]
    kept = similar.drop_similar(docs)
    assert kept.schema == docs.schema
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert Counter(i for i, _ in got) == Counter([min(i for i, _ in g) for g in groups] + [None] * 3)
    for g in groups:
        assert sum(x in g for x in got) == 1


def test_cut(spark, texts):
    a, b, c, passage = (texts[k] for k in ("a", "b", "c", "passage"))
    rows = [(1, f"{a} {passage}"), (5, f"{b} {passage}"), (5, c), (7, c + " tail"), (7, c + " tail"), (3, None), (None, passage), (9, "short")]
    docs = table(spark, rows)
    kept = substring.cut_passages(docs)
    assert kept.schema == docs.schema
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got[1, f"{a} {passage}"] == got[5, c] == got[3, None] == got[None, passage] == got[9, "short"] == 1
    assert [t.strip() for (i, t), n in got.items() if i == 5 and t != c for _ in range(n)] == [b]
    # Rows that repeat id and text are cut alike.
    assert [(t, n) for (i, t), n in got.items() if i == 7] == [("tail", 2)]
    unique = [(i, t) for i, t in rows if i not in (5, 7)] + [(4, f"{b} {passage}")]
    again = {r.doc_id: r.text for r in substring.cut_passages(table(spark, unique)).collect()}
    assert again[4].strip() == b and again[1] == rows[0][1]
