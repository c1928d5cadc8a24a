"""The data source "pdf": spark.read.format("pdf").option("table", ...).load(path), for paths that workers can open.

For stores that only Spark's readers reach, use sources.files.read_pdf, which has the same tables.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.content import page_elements
from ..functions.document import Document
from ..functions.fonts import page_encoders
from ..functions.lexer import tokenize

TABLES = {
    "headers": "doc_id STRING, version STRING, page_count INT, parse_error STRING",
    "elements": "doc_id STRING, page_number INT, seq INT, text STRING, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, font_name STRING, font_size DOUBLE, parse_error STRING",
    "pages": "doc_id STRING, page_number INT, width DOUBLE, height DOUBLE, content BINARY, parse_error STRING",
    "metadata": "doc_id STRING, key STRING, value STRING",
    "tokens": "doc_id STRING, seq BIGINT, type STRING, value STRING, offset BIGINT",
}


class OneFile(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class PdfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.table, self.failfast = options.get("table", "elements"), options.get("mode", "permissive") == "failfast"
        path = options.get("path", "").removeprefix("file://")
        found = glob.glob(os.path.join(path, options.get("pathglobfilter", "*.pdf"))) if os.path.isdir(path) else glob.glob(path)
        if not found:
            raise FileNotFoundError(f"no PDF files at {path!r}")
        self.paths = sorted(found)

    def partitions(self) -> list[InputPartition]:
        return [OneFile(p) for p in self.paths]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        try:
            yield from self.rows(partition.path, data)
        except Exception as e:
            if self.failfast:
                raise
            told = TABLES[self.table].split(", ")
            if told[-1].startswith("parse_error"):
                yield partition.path, *[None] * (len(told) - 2), f"{type(e).__name__}: {e}"

    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        if self.table == "tokens":
            for seq, t in enumerate(tokenize(data)):
                yield path, seq, t.kind, None if t.value is None else t.value.decode("latin-1") if isinstance(t.value, bytes) else str(t.value), t.offset
            return
        d = Document(data)
        if self.table == "headers":
            yield path, d.version, len(d.pages), None
        elif self.table == "metadata":
            yield from ((path, str(k), v) for k, v in d.metadata.items())
        else:
            width = len(TABLES[self.table].split(", "))
            for p in d.pages:
                try:
                    rows = list(self.page(path, d, p))
                except Exception as e:
                    if self.failfast:
                        raise
                    rows = [(path, p.number, *[None] * (width - 3), f"{type(e).__name__}: {e}")]
                yield from rows

    def page(self, path: str, d: Document, p) -> Iterator[tuple]:
        content, box = d.contents(p), p.media_box
        if self.table == "pages":
            yield path, p.number, box[2] - box[0], box[3] - box[1], content, None
        else:
            for seq, e in enumerate(page_elements(content or b"", page_encoders(d, p))):
                yield path, p.number, seq, e.text, e.x, e.y, e.width, e.height, e.font_name, e.font_size, None


class PdfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        table = self.options.get("table", "elements")
        if table not in TABLES:
            raise ValueError(f"table is one of {', '.join(TABLES)}, not {table!r}")
        return TABLES[table]

    def reader(self, schema) -> DataSourceReader:
        return PdfReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfDataSource)
