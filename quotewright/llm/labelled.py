"""The bounded sample of labelled rows on which the classifiers are fitted."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


def sample_rows(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """(id, label, text) of up to ``rows`` labelled documents, those with the smallest id hashes; written. None without labels.

    The choice reads the labels alone; only the chosen texts (a list of bounded length) are looked up.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    if where is not None:
        known = known.where(where)
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(rows).collect()
    if not chosen:
        return None
    pick = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "id long, label int"))
    return stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(pick, "id").select("id", "label", "text"), "labelled")


def sample_features(sample: DataFrame, features) -> list[tuple[int, object]]:
    """(label, feature ids) of the sample's rows; ``features`` turns a text into a numpy array of unsigned 32-bit ids.

    Only the features reach the driver.
    """
    import numpy as np

    def run(batches):
        for batch in batches:
            found = [features(t.as_py()).astype("<u4").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["id", "label", "ids"])

    found = sample.mapInArrow(run, "id long, label int, ids binary").collect()
    found.sort(key=lambda r: (r["id"], r["label"], bytes(r["ids"])))
    return [(r["label"], np.frombuffer(bytes(r["ids"]), "<u4")) for r in found]
