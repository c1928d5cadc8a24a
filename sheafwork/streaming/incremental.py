"""New PDF files of a folder as a stream. Each file is parsed alone, so no watermark or state is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.tables import page_rows
from ..sources.files import as_files

BINARY = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def stream_pdf(spark: SparkSession, path: str, glob: str = "*.pdf", files_per_batch: int = 1000) -> DataFrame:
    """A streaming table of files."""
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
    return as_files(reader.load(path))


def stream_elements(spark: SparkSession, path: str, **how) -> DataFrame:
    """A streaming table of text elements."""
    return page_rows(stream_pdf(spark, path), **how).selectExpr("doc_id", "page_number", "inline(elements)")


def write_available(df: DataFrame, path: str, checkpoint: str, file_format: str = "parquet") -> StreamingQuery:
    """Writes what is there now and ends; the checkpoint remembers which files were read."""
    return df.writeStream.format(file_format).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
