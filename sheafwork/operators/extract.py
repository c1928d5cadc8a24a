"""Extraction: files to page results, whole results, text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import page_elements
from ..functions.document import Document
from .grouping import GroupingConfig, blocks_of, lines_of
from .tables import BROKEN, NONE, PAGE_ELEMENTS, Extensions, check_range, encoders, error_text, parsed

RESULT_ROWS = PAGE_ELEMENTS + ", page_count INT, metadata MAP<STRING, STRING>, parse_error STRING"


def result_rows(files: DataFrame, start: int = 0, end: int | None = None, include_metadata: bool = True, geometry: str = "compatible", decoding: str = "heuristic", mode: str = "permissive", extensions: Extensions = NONE) -> DataFrame:
    """A row for each page in the range, and one of page_number null for the file: its number of pages, metadata, error."""
    check_range(start, end)

    def rows(doc, content):
        nothing = (None, None, None, None)
        try:
            d = Document(content, extensions.filters)
            d.version  # noqa: B018  a file without a header is an error
            info = list(d.metadata.items()) if include_metadata else []
            yield (*nothing, len(d.pages), [(str(k), v) for k, v in info], None)
        except BROKEN as e:
            if mode == "failfast":
                raise
            yield (*nothing, None, [], error_text(e))
            return
        for p in d.pages[start:end]:
            b, error = p.media_box, None
            try:
                data = d.contents(p)
                found = page_elements(data, encoders(d, p, doc, extensions), geometry=geometry, decoding=decoding, extra=extensions.operators) if data else []
            except BROKEN as e:
                if mode == "failfast":
                    raise
                found, error = [], f"page {p.number}: {error_text(e)}"
            yield p.number, b[2] - b[0], b[3] - b[1], [dict(e._asdict(), seq=k) for k, e in enumerate(found)], None, None, error

    return parsed(files, rows, RESULT_ROWS, mode)


def line_column(line: Column) -> Column:
    return F.struct(*(line[c].alias(c) for c in ("text", "y", "x_start", "x_end", "fragment_count")))


def page_results(rows: DataFrame, config: GroupingConfig, geometry: str = "compatible") -> DataFrame:
    """Rows with _page: page_number, width, height, text, elements, lines, blocks (null for the row of the file)."""
    out = blocks_of(lines_of("elements", config, rows), config, geometry)
    names = ("text", "x", "y", "width", "height")
    element = lambda e: F.struct(*(e[c].alias(c) for c in names), F.array(e["x"], e["y"], e["x"] + e["width"], e["y"] + e["height"]).alias("bbox"), e["font_name"].alias("font_name"), e["font_size"].alias("font_size"), F.col("page_number").alias("page_number"))
    block = lambda b: F.struct(*(b[c].alias(c) for c in ("text", "line_count", "x_start", "x_end", "y_start", "y_end")), F.transform(b["lines"], line_column).alias("lines"))
    page = F.struct("page_number", "width", "height", F.array_join(F.transform("lines", lambda n: n["text"]), "\n").alias("text"), F.transform("elements", element).alias("elements"), F.transform("lines", line_column).alias("lines"), F.transform("blocks", block).alias("blocks"))
    return out.withColumn("_page", F.when(F.col("page_number").isNotNull(), page))


def extract(files: DataFrame, start_page: int = 0, end_page: int | None = None, include_metadata: bool = True, config: GroupingConfig | None = None, geometry: str = "compatible", **how) -> DataFrame:
    """One row a file: filename, page_count (of the whole file), pages, metadata, grouping_config, parse_error."""
    config = config or GroupingConfig()
    files = files if "filename" in files.columns else files.withColumn("filename", F.lit(""))
    rows = result_rows(files.withColumn("doc_id", F.struct("doc_id", "filename")), start_page, end_page, include_metadata, geometry, **how)
    pages = page_results(rows, config, geometry)
    # The one exchange: pages meet by file.
    whole = pages.groupBy("doc_id").agg(
        F.max("page_count").alias("page_count"),
        F.array_sort(F.collect_list("_page"), lambda a, b: a["page_number"] - b["page_number"]).alias("pages"),
        F.first("metadata", ignorenulls=True).alias("metadata"),
        F.min("parse_error").alias("parse_error"),
    )
    return whole.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.filename").alias("filename"), "page_count", "pages", "metadata", config.column().alias("grouping_config"), "parse_error")


def all_text(results: DataFrame) -> DataFrame:
    """doc_id and text: pages' texts joined by an empty line."""
    return results.select("doc_id", F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n").alias("text"), "parse_error")


def block_text(results: DataFrame) -> DataFrame:
    """doc_id, page_number, text: blocks joined by an empty line."""
    return results.select("doc_id", F.inline("pages")).select("doc_id", "page_number", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n").alias("text"))


def as_json(results: DataFrame, indent: int | None = None) -> DataFrame:
    """doc_id and result_json, keys in the fixed order; with ``indent`` set out by a Python function, else native."""
    body = F.struct("filename", "page_count", "pages", "metadata", "grouping_config")
    out = results.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("result_json"), "parse_error")
    if indent is None:
        return out

    @F.arrow_udf("string")
    def laid_out(texts):
        import json

        import pyarrow as pa

        return pa.array([None if t is None else json.dumps(json.loads(t), indent=indent, ensure_ascii=False) for t in texts.to_pylist()], pa.string())

    return out.withColumn("result_json", laid_out("result_json"))


def extract_text(files: DataFrame, config: GroupingConfig | None = None, **how) -> DataFrame:
    """doc_id, text, parse_error. Elements end at the page, so only pages' texts meet in the exchange."""
    config = config or GroupingConfig()
    rows = lines_of("elements", config, result_rows(files, include_metadata=False, **how))
    page = F.when(F.col("page_number").isNotNull(), F.struct("page_number", F.array_join(F.transform("lines", lambda n: n["text"]), "\n").alias("text")))
    whole = rows.select("doc_id", page.alias("_page"), "parse_error").groupBy("doc_id").agg(F.array_sort(F.collect_list("_page")).alias("_pages"), F.min("parse_error").alias("parse_error"))
    return whole.select("doc_id", F.array_join(F.transform("_pages", lambda p: p["text"]), "\n\n").alias("text"), "parse_error")


def extract_json(files: DataFrame, start_page: int = 0, end_page: int | None = None, config: GroupingConfig | None = None, indent: int | None = None, **how) -> DataFrame:
    return as_json(extract(files, start_page, end_page, config=config, **how), indent)
