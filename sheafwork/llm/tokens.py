"""Token counts, and BPE encoding and decoding, of whole documents (the dynamic programs are in bpe.py).

Both are one pass over the documents with no shuffle: Arrow batches go through a Python worker, which keeps one model
and a bounded memory of short pieces. Files of vocabularies are read on the executors from ``path``, a parameter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PieceCounter, WordBpe
from .common import documents, small_batches

#: Rows that go back to Spark at once.
OUT_ROWS = 512


@lru_cache(4)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


@lru_cache(4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, OUT_ROWS):
            yield batch.slice(at, OUT_ROWS)


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, fit_chars; with ``prefixes`` also prefix_tokens.

    n_tokens is the sentencepiece model's count without begin or end tokens; it and fit_chars are read from the counts
    that the dynamic program stores for every prefix of every piece. fit_chars is the length in characters of
    the longest prefix that has no more than ``limit`` tokens. prefix_tokens[k] is the count of the first k characters.
    A null text counts as empty; a null id stays null; repeated rows are counted each; an empty table gives no rows.
    Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    schema = f"_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint" + ", prefix_tokens array<int>" * prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [counter.measure(t, limit) for t in texts]
            counts = [n for n, _ in found]
            columns = [batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array([k for _, k in found], pa.int64())]
            if prefixes:
                columns.append(pa.array([counter.prefix_counts(t) for t in texts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_tokens"][: len(columns)])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
    return out.withColumnRenamed("_id", id_col)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256; with ``ids`` the array ids, with ``decoded`` the text decoded from it.

    The ids are those of the tokenizers library for the file at ``path`` without added special tokens; special strings
    inside a text become their ids, as there. The digests are of the ids as little-endian unsigned 32-bit integers and
    of the decoded text in UTF-8. A null text counts as empty; a null id stays null; repeated rows are encoded each; an
    empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    schema = f"_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = word_bpe(path)
        for batch in slices(batches):
            packed = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            numbers = [np.frombuffer(p, "<u4") for p in packed]
            texts = [bpe.decode(n.tolist()) for n in numbers]
            columns = [batch.column(0), pa.array([len(n) for n in numbers], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]
            names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array([n.astype("<i4") for n in numbers], pa.list_(pa.int32())))
                names.append("ids")
            if decoded:
                columns.append(pa.array(texts, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
    return out.withColumnRenamed("_id", id_col)


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded: the text of each array of ids (null: empty), special tokens included."""
    small_batches(encoded.sparkSession)
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in slices(batches):
            texts = [bpe.decode(i or ()) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "decoded"])

    out = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids")).mapInArrow(run, f"_id {kind}, decoded string")
    return out.withColumnRenamed("_id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), limit=4096)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), ids=False, decoded=False)


QUERIES = {"op3_token_counts": op3_token_counts, "op4_bpe_round_trip": op4_bpe_round_trip}
SQL: dict[str, str] = {}
