"""Tables of files: (doc_id, path, filename, length, content), from paths, from bytes, or written from a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.writer import simple_pdf, text_lines


def read_pdf(spark: SparkSession, path: str | list[str], glob: str = "*.pdf", recursive: bool = False, partitions: int | None = None) -> DataFrame:
    """Files at ``path``, by any file system that Spark reads. ``partitions`` deals large files out more evenly."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return as_files(reader.load(path), partitions)


def as_files(binary: DataFrame, partitions: int | None = None) -> DataFrame:
    """A binaryFile table (or stream) as a table of files; the path is the id."""
    out = binary.select(F.col("path").alias("doc_id"), "path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content")
    return out.repartition(partitions) if partitions else out


def from_bytes(spark: SparkSession, files: Iterable[tuple[str, bytes]]) -> DataFrame:
    """Files in memory, by id. They have no path and no file name."""
    rows = [(k, bytearray(v)) for k, v in files]
    return from_column(spark.createDataFrame(rows, "doc_id STRING, content BINARY"))


def from_column(df: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    content = F.col(content_col)
    return df.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("string").alias("path"), F.lit("").alias("filename"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


def written_pdfs(df: DataFrame, id_col: str, build: Callable[..., bytes], *columns: str | Column) -> DataFrame:
    """A table of files: for each row, build(values of columns) on the executors, in Arrow batches."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    cols = df.select(F.col(id_col).alias("doc_id"), *columns)
    cols = cols.toDF("doc_id", *(f"_{k}" for k in range(len(columns))))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores:  # writing files is dear, and a table in one file would be one task
        cols = cols.repartition(cores)
    out = T.StructType([T.StructField("doc_id", cols.schema["doc_id"].dataType), T.StructField("content", T.BinaryType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [build(*values) for values in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.types[0]), pa.array(made, pa.binary())], names=arrow.names)

    return from_column(cols.mapInArrow(run, out))


def text_pdf(text: str | None, filters: list[str] | None = None) -> bytes:
    """A one-page file that shows the text's lines; a null or empty text gives a page that shows one empty line."""
    return simple_pdf([text_lines(text or "")], filters)


def text_pdfs(df: DataFrame, id_col: str, text_col: str, filters: list[str] | None = None) -> DataFrame:
    return written_pdfs(df, id_col, lambda text: text_pdf(text, filters), F.col(text_col).cast("string"))
