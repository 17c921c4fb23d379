"""The corpus pipeline: toxicity, exact dedup, near-dedup, substring dedup and packing, in this order.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what the stage before kept, with the columns of ``documents``; all
but the last return those columns. Every stage covers all its rows and whole texts. What a stage does with nulls, empty
texts, repeated rows and empty tables is stated by its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quotewright.llm.common import stored
from quotewright.llm.exact_dedup import drop_exact_duplicates
from quotewright.llm.packing import pack
from quotewright.llm.similar import drop_similar
from quotewright.llm.substring import cut_passages
from quotewright.llm.toxicity import drop_toxic, fit

SEQUENCE_TOKENS = 2048


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word similarity of 0.8 or more the document with the smallest id stays."""
    return drop_similar(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds are cut out; documents that they fill go."""
    return cut_passages(docs, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens: one row for each piece."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE_TOKENS).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: SQL cannot express the classifier, the chaining or the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
