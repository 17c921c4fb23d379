"""The near-dedup stage against brute force over five-word shingles."""

import random

import pytest

import corpus_pipeline as pipeline
from quotewright.llm import similar

from .conftest import frame, prose


def shingle_set(t):
    words = (t or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def smallest_ids(rows):
    """The smallest id of each component of similarity 0.8 or more."""
    sets = {i: shingle_set(t) for i, t in rows}
    owner = {i: i for i in sets}

    def find(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                owner[b] = a
    return {find(i) for i in sets}


@pytest.fixture(scope="module")
def edited():
    """Texts with copies of one to nine changed words in 220, a large group of near copies of one text, and short and empty ones."""
    rng = random.Random(11)
    texts: list[str | None] = []

    def change(text, n):
        words = text.split(" ")
        for at in rng.sample(range(len(words)), n):
            words[at] = f"changed{rng.randint(0, 9999)}"
        return " ".join(words)

    for n in range(1, 10):
        one = prose(rng, 220)
        texts += [one, change(one, n), change(one, n)]
    base = prose(rng, 200)
    texts += [change(base, rng.randint(1, 4)) for _ in range(60)]
    texts += [None, "", " \n", "one two", "ONE  two", "one two three four five", "one two three four five six"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("cap", [0, similar.PAIR_CAP, 10_000])
def test_near_dedup_stage(spark, edited, monkeypatch, cap):
    monkeypatch.setattr(similar, "PAIR_CAP", cap)
    docs = frame(spark, [*edited, (None, "no id at all")])
    kept = pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    want = smallest_ids(edited)
    assert len(want) < len(edited) - 60
    assert {r.doc_id for r in kept.collect()} == want | {None}


def test_no_documents(spark, none):
    assert pipeline.near_dedup(spark, none, "").count() == 0
