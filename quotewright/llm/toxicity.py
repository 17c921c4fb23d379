"""Toxicity: cumulative-link ordinal regression over sparse text features.

Features are the distinct lower-cased words of a text and the proper beginnings of three to seven letters of longer ones, hashed to 32
bits. One weight vector is shared by ordered thresholds: P(grade >= k) = logistic(w . x - threshold_k). Its L1-penalised
likelihood is minimised by proximal gradient steps; the weights that stay above zero are the model. No weight is negative:
a clean word must not make up for a toxic one, however long the text.

Labels say only whether a text is toxic, so grades are made from them: 0 clean, 1 toxic, 2 toxic with two or more
different words that occur (nearly) only in toxic rows of the sample. The penalty and the cut are chosen on folds of the sample
that the fit did not see; the thresholds are then moved so that one half is the cut. A text is rejected when
P(grade >= 1) >= 0.5; the expected severity is the sum of P(grade >= k).

Fitting takes ``FIT_ROWS`` labelled rows at most (those with the smallest id hashes); scoring reads every whole text.

Defined results: a null, empty or word-free text has no features and scores by the thresholds alone; without toxic
labels nothing is rejected and severity is 0; rows that repeat an id score alike for equal texts; null ids are scored.
An empty table gives an empty result. Only the id and text columns are inputs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkCache, discard
from .labelled import sample_features, sample_rows

FIT_ROWS = 10_000
#: Features are used that this many sample rows and this share of the rows that hold them make toxic; of those the model considers so many.
LEAST_ROWS, LEAST_SHARE, MOST_FEATURES = 3, 0.3, 20_000
#: Penalties and cuts to choose from, folds, and how many caught toxic rows outweigh one rejected clean row, both as shares of their kind.
PENALTIES, CUTS = (0.25, 0.5, 1.0), (0.2, 0.3, 0.4, 0.5)
FOLDS, REJECTED_COST = 3, 10
ROUNDS = 200
GRADES = 3
BEGINNINGS = range(3, 8)

_words = re.compile(r"[^\W\d_]+").findall


def _chunk_features(chunk: str) -> bytes:
    import xxhash

    out = []
    for word in _words(chunk.lower()):
        # The lowest bit tells whole words from beginnings.
        out.append((xxhash.xxh32_intdigest(f"w:{word}".encode("utf-8", "replace")) | 1).to_bytes(4, "little"))
        out += [(xxhash.xxh32_intdigest(f"{n}:{word[:n]}".encode("utf-8", "replace")) & ~1).to_bytes(4, "little") for n in BEGINNINGS if n < len(word)]
    return b"".join(out)


_cache: list[ChunkCache] = []


def features(text: str | None) -> np.ndarray:
    if not _cache:
        _cache.append(ChunkCache(_chunk_features))
    return np.unique(np.frombuffer(_cache[0].gather(set((text or "").split())), "<u4"))


def among(found: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in ``wanted`` (ascending) of those of ``found`` that it holds."""
    if not len(wanted):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
    return at[wanted[at] == found]


class Model:
    """Thresholds in ascending order, and the features (ascending) with their weights."""

    def __init__(self, thresholds: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        self.thresholds, self.ids, self.weights = thresholds, ids, weights

    def exceed(self, found: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, for a text's distinct features."""
        return _logistic(self.weights[among(found, self.ids)].sum() - self.thresholds)


def _logistic(v):
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


def grades(sample: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Severity grades of sample rows."""
    toxic = np.array([label > 0 for label, _ in sample], bool)
    words = [ids[ids & 1 == 1] for _, ids in sample]
    rows = np.repeat(np.arange(len(sample)), [len(w) for w in words])
    values, place = np.unique(np.concatenate(words), return_inverse=True)
    n, bad = np.bincount(place, minlength=len(values)), np.bincount(place, toxic[rows], minlength=len(values))
    marker = (bad >= LEAST_ROWS) & (bad >= 0.9 * n)
    hits = np.bincount(rows, marker[place], minlength=len(sample))
    return np.where(toxic, np.where(hits >= 2, 2, 1), 0)


def _nothing() -> Model:
    return Model(np.array([35.0, 36.0]), np.zeros(0, np.uint32), np.zeros(0))


def useful(sample: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """The sample with those features alone that may speak for toxicity."""
    toxic = np.array([label > 0 for label, _ in sample], bool)
    rows = np.repeat(np.arange(len(sample)), [len(ids) for _, ids in sample])
    ids, column = np.unique(np.concatenate([ids for _, ids in sample]), return_inverse=True)
    bad = np.bincount(column, toxic[rows], minlength=len(ids))
    good = ids[(bad >= LEAST_ROWS) & (bad >= LEAST_SHARE * np.bincount(column, minlength=len(ids)))]
    return [(label, good[among(found, good)]) for label, found in sample]


def fit_sample(sample: list[tuple[int, np.ndarray]]) -> Model:
    """The model with the penalty and the cut that serve rows best which the fit did not see."""
    if not any(label > 0 for label, _ in sample):
        return _nothing()
    sample = useful(sample)
    toxic = np.array([label > 0 for label, _ in sample], bool)
    fold = np.empty(len(sample), np.int64)
    for kind in (toxic, ~toxic):
        fold[kind] = np.arange(kind.sum()) % FOLDS
    best = (-np.inf, PENALTIES[-1], 0.5)
    for penalty in PENALTIES[::-1]:
        p = np.zeros(len(sample))
        for k in range(FOLDS):
            model = fit_grades([x for x, f in zip(sample, fold, strict=True) if f != k], penalty)
            for i in np.flatnonzero(fold == k).tolist():
                p[i] = model.exceed(sample[i][1])[0]
        for cut in CUTS[::-1]:
            value = (p[toxic] >= cut).mean() - REJECTED_COST * ((p[~toxic] >= cut).mean() if (~toxic).any() else 0)
            if value > best[0] + 1e-9:
                best = (value, penalty, cut)
    model = fit_grades(sample, best[1])
    return Model(model.thresholds + np.log(best[2] / (1 - best[2])), model.ids, model.weights)


def fit_grades(sample: list[tuple[int, np.ndarray]], penalty: float) -> Model:
    """Thresholds and weights of the sample's grades."""
    if not any(label > 0 for label, _ in sample):
        return _nothing()
    y = grades(sample)
    rows = np.repeat(np.arange(len(sample)), [len(ids) for _, ids in sample])
    ids, column = np.unique(np.concatenate([ids for _, ids in sample]), return_inverse=True)
    share = np.array([max((y >= k).mean(), 0.5 / len(y)) for k in range(1, GRADES)])
    thresholds = -np.log(share / np.maximum(1 - share, 0.5 / len(y)))
    thresholds = np.maximum.accumulate(thresholds + np.arange(GRADES - 1) * 1e-3)

    def cumulative(f: np.ndarray) -> np.ndarray:
        """P(grade <= k) with k from -1 to the last, one row for each text."""
        inner = _logistic(thresholds[None, :] - f[:, None])
        return np.hstack((np.zeros((len(f), 1)), inner, np.ones((len(f), 1))))

    def slope(c: np.ndarray) -> np.ndarray:
        here = np.arange(len(y))
        return 1 - c[here, y + 1] - c[here, y]

    first = slope(cumulative(np.zeros(len(y))))
    pull = -np.bincount(column, first[rows], minlength=len(ids))
    pull[np.bincount(column, y[rows] > 0, minlength=len(ids)) < LEAST_ROWS - 1] = 0
    use = np.sort(np.argsort(-pull, kind="stable")[:MOST_FEATURES])
    use = use[pull[use] > penalty]
    if not len(use):
        return _nothing()
    new = np.full(len(ids), -1)
    new[use] = np.arange(len(use))
    keep = new[column] >= 0
    rows, column, ids = rows[keep], new[column[keep]], ids[use]
    # Rows that hold none of the features differ in their grade alone, so one of each grade stands for all.
    some = np.unique(rows)
    alone = np.bincount(np.delete(y, some), minlength=GRADES)
    rows, y = np.searchsorted(some, rows), np.concatenate((y[some], np.arange(GRADES)))
    stands = np.concatenate((np.ones(len(some)), alone))
    w, past, past_t = np.zeros(len(ids)), np.full(len(ids), 1e-6), np.full(GRADES - 1, 1e-6)
    for _ in range(ROUNDS):
        c = cumulative(np.bincount(rows, w[column], minlength=len(y)))
        s = slope(c)
        g = np.bincount(column, s[rows], minlength=len(ids))
        past += g * g
        step = 0.5 / np.sqrt(past)
        w = np.maximum(w - step * (g + penalty), 0)
        p = np.maximum(c[np.arange(len(y)), y + 1] - c[np.arange(len(y)), y], 1e-12)
        bend = [c[:, k + 1] * (1 - c[:, k + 1]) * stands / p for k in range(GRADES - 1)]
        gt = np.array([bend[k][y == k + 1].sum() - bend[k][y == k].sum() for k in range(GRADES - 1)])
        past_t += gt * gt
        thresholds = np.maximum.accumulate(thresholds - 0.5 / np.sqrt(past_t) * gt + np.arange(GRADES - 1) * 1e-9)
    kept = w != 0
    return Model(thresholds, ids[kept], w[kept])


def frequent(sample: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The features, ascending, of ``LEAST_ROWS`` rows or more."""
    ids, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *(ids for _, ids in sample)]), return_counts=True)
    return ids[n >= LEAST_ROWS]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", where=None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the sample; of its clean rows the driver gets only the features that may be in the model, as the toxic rows have them."""
    chosen = sample_rows(docs, labels, label_col, FIT_ROWS, where, id_col, text_col)
    if chosen is None:
        return _nothing()
    wanted = frequent(sample_features(chosen.where("label > 0"), features))

    def some(text: str | None) -> np.ndarray:
        return wanted[among(features(text), wanted)]

    sample = sample_features(chosen, some)
    discard(chosen)
    return fit_sample(sample)


def _scorer(model: Model):
    """A function from texts to P(grade >= k), one row for each text.

    The model has ``MOST_FEATURES`` weights at most. A task remembers for each chunk of text only the features that
    the model holds, so most chunks add nothing.
    """
    held = frozenset(model.ids.tolist())
    cache = ChunkCache(lambda chunk: np.array([x for x in np.frombuffer(_chunk_features(chunk), "<u4").tolist() if x in held], "<u4").tobytes())
    empty = model.exceed(np.zeros(0, np.uint32))

    def exceed(texts: pa.Array) -> np.ndarray:
        out = np.empty((len(texts), GRADES - 1))
        for i, text in enumerate(texts):
            found = cache.gather(set((text.as_py() or "").split()))
            out[i] = model.exceed(np.unique(np.frombuffer(found, "<u4"))) if found else empty
        return out

    return exceed


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_severity, p_toxic, severity, toxic), one row for each row of ``docs``."""

    def run(batches):
        exceed = _scorer(model)
        for batch in batches:
            out = exceed(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.sum(axis=1)), pa.array(out[:, 0]), pa.array((out >= 0.5).sum(axis=1).astype(np.int32)), pa.array(out[:, 0] >= 0.5)], ["id", "expected_severity", "p_toxic", "severity", "toxic"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, expected_severity double, p_toxic double, severity int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without rejected documents: one pass, no shuffle."""
    place = docs.columns.index(text_col)

    def run(batches):
        exceed = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(exceed(batch.column(place))[:, 0] < 0.5))

    return docs.mapInArrow(run, docs.schema)
