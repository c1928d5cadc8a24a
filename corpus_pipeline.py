"""From raw documents to token ids: quality rules, exact dedup, near dedup, source mixing, encoding.

Each stage takes (spark, docs, sf_dir), where docs are all documents that the stage before kept, and returns a
DataFrame; all but the last return documents with their columns. Between stages the documents are written as Parquet
and read again, so a lost executor costs no more than its part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheafwork.llm.common import documents, drop_shared, write_shared
from sheafwork.llm.exact_dedup import drop_copies
from sheafwork.llm.mixing import mix_sources
from sheafwork.llm.quality import keep_good
from sheafwork.llm.simhash import drop_near_copies
from sheafwork.llm.tokens import encode_documents, vocabulary

#: Of the tokens that are left, the mix takes so many, each document once at most.
SHARE, EPOCHS, SEED = (8, 10), 1, 7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8 or more."""
    return drop_near_copies(docs, n=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs, share=SHARE, max_epochs=EPOCHS, seed=SEED).select("document.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, vocabulary("word_bpe_49k.json"), ids=True, decoded=False)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mix_sources", mix), ("bpe_encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs, path = write_shared(stage(spark, docs, sf_dir), name)
        if last:
            drop_shared(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: The outlier estimate and the near copies can't be said in SQL.
ORACLE_SQL = None
