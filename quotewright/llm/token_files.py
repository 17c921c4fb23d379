"""Token-id files: documents compressed one by one against a shared zstandard dictionary.

A file set is a folder with two Parquet tables. ``dictionary`` has one row: the dictionary's bytes and their SHA-256.
``chunks`` has rows of some megabytes in ascending id order: the documents' ids, token counts and byte offsets (the
offset index), the dictionary hash, and a payload of independent frames. One document is read by pruning chunks on their
first and last id, slicing its frame by the offsets and decompressing that frame only.

Ids are serialised as little-endian unsigned integers of 16 bits where the vocabulary allows it, else of 32. The
dictionary is trained on a bounded sample of documents: the ``SAMPLE_DOCS`` with the smallest id hashes, and of each the
first ``SAMPLE_BYTES``; where that is too little to train on, the sample itself serves as a raw dictionary. Every document
is encoded and written.

Defined results: a null text counts as empty; each document ends with id 0, so none is empty; null ids come first;
rows that repeat an id follow each other in no stated order; an empty table gives a file set without chunks. Only the
id and text columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunked_tokenizer import slices, tokenizer
from .common import scratch_dir

END_ID = 0
SAMPLE_DOCS = 1_000
SAMPLE_BYTES = 65_536
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: A chunk ends when its payload or its number of documents reaches this.
CHUNK_BYTES = 4_000_000
CHUNK_DOCS = 8_192

CHUNK_SCHEMA = "part int, seq int, first_id long, last_id long, tokens_before long, tokens long, width int, dict_sha256 string, doc_ids array<long>, n_tokens array<int>, ends array<long>, payload binary"


def _serialised(packed: bytes, width: int) -> bytes:
    import numpy as np

    ids = packed + END_ID.to_bytes(4, "little")
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _width(path: str) -> int:
    return 2 if tokenizer(path).vocab_size <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> bytes:
    """Dictionary bytes from the bounded sample."""
    import zstandard

    ids = [r[0] for r in docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS).collect()]
    if not ids:
        return b"\0" * 8

    def run(batches):
        width = _width(tokenizer_path)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in slices(len(texts)):
                yield pa.RecordBatch.from_arrays([pa.array([_serialised(x, width)[:SAMPLE_BYTES] for x in tokenizer(tokenizer_path).packed(texts[part])], pa.binary())], ["data"])

    rows = docs.where(F.col(id_col).isin(ids)).select(text_col).limit(2 * SAMPLE_DOCS).mapInArrow(run, "data binary").collect()
    samples = sorted(bytes(r[0]) for r in rows)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b"\0")


def _dictionary(data: bytes):
    import zstandard

    trained = data[:4] == zstandard.MAGIC_NUMBER.to_bytes(4, "little") or data[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write the file set into ``folder``."""
    spark = docs.sparkSession
    data = train_dictionary(docs, tokenizer_path, id_col, text_col)
    sha = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(sha, bytearray(data))], "dict_sha256 string, data binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Ranges of ids from approximate quantiles: a scan of the id column alone, so that texts are shuffled once and never sampled.
    quantiles = docs.select(F.col(id_col).cast("double").alias("id")).approxQuantile("id", [i / parts for i in range(1, parts)], max(0.1 / parts, 1e-5)) if parts > 1 else []
    part = _range_of(F.col("id"), sorted({int(q) for q in quantiles}))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("part", F.when(F.col("id").isNull(), 0).otherwise(part).cast("int"))
    ordered = rows.repartitionById(parts, "part").sortWithinPartitions("part", F.col("id").asc_nulls_first())
    ordered.mapInArrow(_chunk_writer(data, sha, tokenizer_path), CHUNK_SCHEMA).write.parquet(f"{folder}/chunks")


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds lie below ``value``: first among every k-th, then among the k between two of these."""
    if not bounds:
        return F.lit(0)
    k = max(1, round(len(bounds) ** 0.5))
    all_bounds, coarse = (F.array(*[F.lit(b) for b in bs]).cast("array<long>") for bs in (bounds, bounds[k - 1 :: k]))
    below = F.size(F.filter(coarse, lambda b: b < value)) * k if len(bounds) >= k else F.lit(0)
    return below + F.size(F.filter(F.slice(all_bounds, below + 1, F.lit(k)), lambda b: b < value))


def _chunk_writer(data: bytes, sha: str, tokenizer_path: str):
    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(data)).compress
        width = _width(tokenizer_path)
        part, seq, before = None, 0, 0
        ids, counts, ends, frames = [], [], [], []

        def chunk():
            known = [i for i in ids if i is not None]
            tokens = sum(counts)
            values = [part, seq, min(known, default=None), max(known, default=None), before, tokens, width, sha, ids, counts, ends, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _chunk_types(), strict=True)], _CHUNK_NAMES), tokens

        for batch in batches:
            all_ids, texts, owners = (c.to_pylist() for c in batch.columns)
            for s in slices(len(texts)):
                for i, owner, packed in zip(all_ids[s], owners[s], tokenizer(tokenizer_path).packed(texts[s]), strict=True):
                    if ids and (owner != part or ends[-1] >= CHUNK_BYTES or len(ids) >= CHUNK_DOCS):
                        out, tokens = chunk()
                        yield out
                        before, seq = before + tokens, seq + 1
                        ids, counts, ends, frames = [], [], [], []
                    if owner != part:
                        part, seq, before = owner, 0, 0
                    raw = _serialised(packed, width)
                    frame = press(raw)
                    ids.append(i)
                    counts.append(len(raw) // width)
                    frames.append(frame)
                    ends.append((ends[-1] if ends else 0) + len(frame))
        if ids:
            yield chunk()[0]

    return run


_CHUNK_NAMES = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]


def _chunk_types() -> list[pa.DataType]:
    one = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return [one[c.split()[1]] for c in CHUNK_SCHEMA.split(", ")]


def read_dictionary(spark: SparkSession, folder: str) -> tuple[bytes, str]:
    """The dictionary and its hash, which must agree."""
    row = spark.read.schema("dict_sha256 string, data binary").parquet(f"{folder}/dictionary").first()
    data = bytes(row["data"])
    if hashlib.sha256(data).hexdigest() != row["dict_sha256"]:
        raise ValueError("the dictionary does not match its hash")
    return data, row["dict_sha256"]


def _frames(data: bytes, sha: str, chunk: dict, places=None):
    """(place, packed ids as 32-bit integers) of a chunk's documents."""
    import numpy as np
    import zstandard

    if chunk["dict_sha256"] != sha:
        raise ValueError("the chunk was written with another dictionary")
    unpress = zstandard.ZstdDecompressor(dict_data=_dictionary(data)).decompress
    ends, payload, kind = chunk["ends"], memoryview(chunk["payload"]), "<u2" if chunk["width"] == 2 else "<u4"
    for at in range(len(ends)) if places is None else places:
        raw = unpress(payload[ends[at - 1] if at else 0 : ends[at]])
        yield at, np.frombuffer(raw, kind).astype("<u4").tobytes()


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files."""
    data, sha = read_dictionary(spark, folder)
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{folder}/chunks")
    # One row for each range of ids: as many as writing tasks.
    totals = {r["part"]: r["n"] for r in chunks.groupBy("part").agg(F.sum("tokens").alias("n")).collect()}
    starts, at = {}, 0
    for p in sorted(totals):
        starts[p] = at
        at += totals[p]

    def run(batches):
        for batch in batches:
            for chunk in batch.to_pylist():
                start = starts[chunk["part"]] + chunk["tokens_before"]
                begins = [start]
                for n in chunk["n_tokens"][:-1]:
                    begins.append(begins[-1] + n)
                crc = [zlib.crc32(x) for _, x in _frames(data, sha, chunk)]
                yield pa.RecordBatch.from_arrays([pa.array(chunk["doc_ids"], pa.int64()), pa.array(begins, pa.int64()), pa.array(chunk["n_tokens"], pa.int64()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return chunks.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with this id, decompressing only their frames."""
    import numpy as np

    data, sha = read_dictionary(spark, folder)
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{folder}/chunks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id) & F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    out = []
    for row in chunks.orderBy("part", "seq").collect():
        chunk = row.asDict()
        places = [i for i, d in enumerate(chunk["doc_ids"]) if d == doc_id]
        out += [np.frombuffer(x, "<u4").tolist() for _, x in _frames(data, sha, chunk, places)]
    return out


def token_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the file set into the shared folder and read it back as ``read_digests`` does."""
    folder = f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, folder, tokenizer_path, id_col, text_col)
    return read_digests(docs.sparkSession, folder)
