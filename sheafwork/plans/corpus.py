"""One object for a corpus of PDF files, with every table and extraction as a method."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..logs import logger
from ..operators import extract, grouping, tables
from ..operators.grouping import GroupingConfig
from ..sources import files as sources


class PdfCorpus:
    """Lazy: nothing is read before an action. Used as a context, it keeps the files' parsed pages for reuse until it ends."""

    def __init__(self, files: DataFrame, mode: str = "permissive", geometry: str = "compatible", decoding: str = "heuristic", extensions: tables.Extensions = tables.NONE) -> None:
        self.files, self.mode = files, mode
        self.how = {"geometry": geometry, "decoding": decoding, "mode": mode, "extensions": extensions}
        self.kept: DataFrame | None = None

    @classmethod
    def read(cls, spark: SparkSession, path: str | list[str], glob: str = "*.pdf", recursive: bool = False, **how) -> PdfCorpus:
        logger.info("PDF corpus at %s", path)
        return cls(sources.read_pdf(spark, path, glob, recursive), **how)

    @classmethod
    def of_bytes(cls, spark: SparkSession, files, **how) -> PdfCorpus:
        return cls(sources.from_bytes(spark, files), **how)

    def __enter__(self) -> PdfCorpus:
        self.kept = tables.page_rows(self.files, **self.how).persist()
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()
            self.kept = None

    def headers(self) -> DataFrame:
        return tables.headers(self.files, self.mode)

    def tokens(self) -> DataFrame:
        return tables.tokens(self.files, self.mode)

    def xref(self) -> DataFrame:
        return tables.xref(self.files, self.mode)

    def trailer(self) -> DataFrame:
        return tables.trailer(self.files, self.mode)

    def objects(self, decode: bool = False) -> DataFrame:
        return tables.objects(self.files, self.mode, decode)

    def pages(self, start_page: int = 0, end_page: int | None = None, contents: bool = True) -> DataFrame:
        return tables.pages(self.files, start_page, end_page, contents, self.mode, self.how["extensions"])

    def fonts(self) -> DataFrame:
        return tables.fonts(self.files, mode=self.mode)

    def operators(self) -> DataFrame:
        return tables.operators(self.files, mode=self.mode)

    def metadata(self) -> DataFrame:
        return tables.metadata(self.files, self.mode)

    def page_rows(self, start_page: int = 0, end_page: int | None = None) -> DataFrame:
        tables.check_range(start_page, end_page)
        if self.kept is not None:
            upto = F.lit(True) if end_page is None else F.col("page_number") <= end_page
            return self.kept.filter((F.col("page_number") > start_page) & upto | F.col("page_number").isNull())
        return tables.page_rows(self.files, start_page, end_page, **self.how)

    def errors(self) -> DataFrame:
        """doc_id, page_number (null: the file) and parse_error of what can't be read."""
        return self.page_rows().filter("parse_error IS NOT NULL").select("doc_id", "page_number", "parse_error")

    def elements(self, start_page: int = 0, end_page: int | None = None) -> DataFrame:
        return self.page_rows(start_page, end_page).select("doc_id", "page_number", F.inline("elements"))

    def lines(self, config: GroupingConfig | None = None) -> DataFrame:
        """Lines by page; pages come as arrays, so nothing is shuffled."""
        rows = grouping.lines_of("elements", config or GroupingConfig(), self.page_rows())
        return rows.select("doc_id", "page_number", F.posexplode("lines").alias("_n", "_l")).select("doc_id", "page_number", (F.col("_n") + 1).alias("line_no"), "_l.*")

    def blocks(self, config: GroupingConfig | None = None) -> DataFrame:
        config = config or GroupingConfig()
        rows = grouping.blocks_of(grouping.lines_of("elements", config, self.page_rows()), config, self.how["geometry"])
        return rows.select("doc_id", "page_number", F.posexplode("blocks").alias("_n", "_b")).select("doc_id", "page_number", (F.col("_n") + 1).alias("block_no"), "_b.*")

    def extract(self, start_page: int = 0, end_page: int | None = None, include_metadata: bool = True, *, grouping_mode: str = "cluster", y_tolerance: float = 5.0, x_tolerance: float = 5.0, space_width: float = 3.0, line_gap_threshold: float = 1.5) -> DataFrame:
        config = GroupingConfig(y_tolerance, x_tolerance, space_width, line_gap_threshold, grouping_mode)
        return extract.extract(self.files, start_page, end_page, include_metadata, config, **self.how)

    def extract_text(self, *, grouping_mode: str = "cluster", y_tolerance: float = 5.0) -> DataFrame:
        return extract.extract_text(self.files, GroupingConfig(y_tolerance=y_tolerance, grouping_mode=grouping_mode), **self.how)

    def extract_json(self, start_page: int = 0, end_page: int | None = None, *, grouping_mode: str = "cluster", y_tolerance: float = 5.0, indent: int | None = None) -> DataFrame:
        return extract.extract_json(self.files, start_page, end_page, GroupingConfig(y_tolerance=y_tolerance, grouping_mode=grouping_mode), indent, **self.how)
