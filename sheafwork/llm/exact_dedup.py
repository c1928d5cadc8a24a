"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside the groups.

The grouping key is (hash, normalised text): equal hashes meet in one group only if their bytes agree, so a
collision makes two groups. Copies are combined in each map task before the shuffle, so a hot group arrives as one
row a task. The keys, without texts, then go back to the documents; hot keys are broadcast (their number is bounded).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, documents, hot_safe_lookup


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h128, text_sha256, keep_id, group_size): one row for each different normalised text."""
    base = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    grouped = base.groupBy(F.unhex(F.md5("_norm")).alias("_h128"), "_norm").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return grouped.select("_h128", F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, and the columns named in ``carry``.

    Null text counts as empty. A null id is kept only if all ids of its group are null. Rows that repeat the smallest
    id of their group are one document given twice: each is marked kept. An empty table gives no rows. Other columns,
    whatever their names, are ignored.
    """
    classes = cut(copy_classes(docs, id_col, text_col))
    norm = normalised(F.col(text_col))
    facts = docs.select(F.col(id_col).alias("_id"), F.unhex(F.md5(norm)).alias("_h128"), F.sha2(norm, 256).alias("text_sha256"), F.struct(F.lit(0).alias("_none"), *(F.col(c) for c in carry)).alias("_carry"))
    found = hot_safe_lookup(facts, classes, ["_h128", "text_sha256"], "group_size", F.col("_id"))
    out = found.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "_carry")
    return out.select(id_col, "keep_id", "group_size", "kept", "text_sha256", *(F.col("_carry")[c].alias(f"carried_{c}") for c in carry))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text is that of a row with a smaller id; all columns stay as they are."""
    names = docs.columns
    marked = exact_duplicates(docs, id_col, text_col, carry=tuple(c for c in names if c != id_col))
    return marked.filter("kept").select(*(F.col(c if c == id_col else f"carried_{c}").alias(c) for c in names))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


QUERIES = {"op10_exact_dedup": op10_exact_dedup}
SQL = {
    "op10_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
}
