"""Quality classifier: hashed word n-grams, logistic regression fitted by follow-the-regularised-leader.

Tokens are runs of word characters or of other non-space characters, case kept. Features are single tokens and pairs of
neighbours, hashed into ``2 ** BITS`` weights; a text is the unit vector over its distinct features, and its score the
logistic of a sparse dot product. Fitting takes ``FIT_ROWS`` labelled rows at most (those with the smallest id
hashes) and ``EPOCHS`` passes; scoring reads every whole text.

Defined results: a null or empty text scores by the intercept alone; without any label the score is 0.5, and with
labels of one class it leans to that class; null labels and labels without a document are not used, repeated ones count
each time; rows that repeat an id score alike for equal texts. An empty table gives an empty result.
Only the id and text columns are inputs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ChunkCache, discard
from .labelled import sample_features, sample_rows

BITS = 20
FIT_ROWS = 8_000
EPOCHS = 2
REPEAT_STEPS = 16
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.1

_tokens = re.compile(r"\w+|[^\w\s]+").findall
_cache: list[ChunkCache] = []


def _hashes(chunk: str) -> bytes:
    import xxhash

    return b"".join(xxhash.xxh32(t.encode("utf-8", "replace")).intdigest().to_bytes(4, "little") for t in _tokens(chunk))


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a text, below ``2 ** BITS``; first the intercept's and the repeat step's, beyond them.

    There is a step for each of ``REPEAT_STEPS`` shares of repeated pairs, as n-grams that never occurred in the sample
    say nothing of a text that says one thing again and again.
    """
    if not _cache:
        _cache.append(ChunkCache(_hashes))
    tokens = np.frombuffer(_cache[0].gather((text or "").split()), "<u4")
    pairs = tokens[:-1] * np.uint32(0x9E3779B1) ^ tokens[1:]
    repeated = 1 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0.0
    found = np.unique(np.concatenate((tokens, pairs * np.uint32(0x85EBCA6B))) >> np.uint32(32 - BITS))
    return np.concatenate(([1 << BITS, (1 << BITS) + 1 + int(repeated * REPEAT_STEPS)], found)).astype(np.uint32)


def values(ids: np.ndarray) -> np.ndarray:
    """The values that go with features: 1 for the intercept and the step, and a unit vector."""
    x = np.full(len(ids), 1 / np.sqrt(max(1, len(ids) - 2)))
    x[:2] = 1
    return x


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression; those beyond ``2 ** BITS`` are the intercept's and the steps'."""

    def __init__(self):
        size = (1 << BITS) + 1 + REPEAT_STEPS
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, ids: np.ndarray, label: int) -> None:
        at, x = ids.astype(np.int64), values(ids)
        w = self.weights(at)
        g = (_logistic(float(w @ x)) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def _logistic(v: float) -> float:
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", where: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights from the labelled rows for which ``where`` holds."""
    model = Ftrl()
    chosen = sample_rows(docs, labels, label_col, FIT_ROWS, where, id_col, text_col)
    sample = sample_features(chosen, features) if chosen is not None else []
    discard(chosen)
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(sample)).tolist():
            model.learn(sample[i][1], int(sample[i][0] > 0))
    return model.weights().astype(np.float32).astype(float)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score), one row for each row of ``docs``; the weights have a fixed size and travel as a broadcast."""

    def run(batches):
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(1)):
                ids = features(text.as_py())
                out[i] = _logistic(float(weights[ids] @ values(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, score double")


def held_out(id_col: str) -> Column:
    """Whether the id belongs to the rows that are kept from fitting: CRC-32 of its decimal text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
