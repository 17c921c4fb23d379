"""Thin registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import round_trip_digests

    docs = _read(spark, sf_dir, "documents")
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op2_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = _read(spark, sf_dir, "documents")
    return score(docs, fit(docs, _read(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import token_digests

    return token_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    found = exact_duplicates(_read(spark, sf_dir, "documents"), extra={"text_sha256": F.sha2("norm", 256)})
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op6_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import repeated_passages

    found = repeated_passages(_read(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"id": "doc_id", "start": "start_word", "end": "end_word", "anchor": "first_doc_id", "anchor_start": "first_start_word", "anchor_end": "first_end_word"})


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, held_out, score

    docs = _read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, _read(spark, sf_dir, "labels"), where=~held_out("id")))
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    placed = shard_documents(_read(spark, sf_dir, "documents"), shards=8)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    packed = pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
    return packed.withColumnRenamed("id", "doc_id").withColumn("length", F.col("length").cast("long"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_adaptive_ann, op3_toxicity, op4_token_files, op5_exact_dedup, op6_chained_passages, op7_quality, op8_minimax_shards, op9_pack, op10_simhash)}

ORACLE_SQL = {
    "op5_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
        ), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g USING (norm)
    """,
}
