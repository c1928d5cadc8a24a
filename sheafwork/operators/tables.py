"""Tables of PDF files: each function takes files (doc_id, content, ...) and returns one table of SURVEY's data model.

A file is parsed in a Python worker, on Arrow batches, in one hop without a shuffle; memory is bounded by a file and a
batch of output rows. What can't be read fails the job in mode "failfast". In mode "permissive" the tables of headers,
objects, pages, fonts, operators and page rows have a row with parse_error for each file, page or object that can't be
read, and all of the others; tables without that column lack what can't be read. Filters on pages are arguments, as no
optimizer moves them into a parser.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.codecs import filter_names
from ..functions.content import page_elements
from ..functions.content import operators as content_operators
from ..functions.document import Document, header_version, opened
from ..functions.fonts import FontEncoder, encoder_of, page_encoders
from ..functions.lexer import tokenize
from ..functions.values import INT_MAX, ParseError, Stream, kind_of, to_json
from ..session import checkpointed

#: Errors that a broken file can raise; anything else is a fault of ours.
BROKEN = (ParseError, ValueError, TypeError, KeyError, IndexError, OverflowError, RecursionError)
OUT_ROWS = 4096


@dataclass(frozen=True)
class Extensions:
    """What users add: decoders by filter name, operators by name, and a function (doc_id, font name) to FontEncoder or None."""

    filters: dict[str, Callable] = field(default_factory=dict)
    operators: dict[str, Callable] = field(default_factory=dict)
    font_resolver: Callable | None = None


NONE = Extensions()


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


HEADERS = "version STRING, page_count INT, parse_error STRING"
TOKENS = "seq BIGINT, type STRING, i BIGINT, r DOUBLE, s STRING, b BINARY, bool BOOLEAN, offset BIGINT"
XREF = "section INT, obj_num BIGINT, offset BIGINT, generation INT, free BOOLEAN, entry_type INT, object_stream_num BIGINT, index_in_stream INT"
TRAILER = "section INT, key STRING, value STRING"
OBJECTS = "obj_num BIGINT, gen_num INT, kind STRING, value STRING, stream_data BINARY, file_offset BIGINT, parse_error STRING"
PAGES = "page_number INT, width DOUBLE, height DOUBLE, media_box ARRAY<DOUBLE>, resources STRING, content BINARY, parse_error STRING"
FONTS = "page_number INT, font_name STRING, widths MAP<INT, DOUBLE>, base_encoding STRING, differences MAP<INT, STRING>, to_unicode MAP<INT, STRING>, parse_error STRING"
OPERATORS = "page_number INT, seq INT, operator STRING, operands STRING, offset BIGINT, parse_error STRING"
METADATA = "key STRING, value STRING"
ELEMENT = (
    "seq INT, text STRING, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, font_name STRING, font_size DOUBLE, char_spacing DOUBLE, "
    "word_spacing DOUBLE, horizontal_scaling DOUBLE, text_render_mode INT, raw_bytes BINARY"
)
PAGE_ELEMENTS = f"page_number INT, width DOUBLE, height DOUBLE, elements ARRAY<STRUCT<{', '.join(c.replace(' ', ': ', 1) for c in ELEMENT.split(', '))}>>"
PAGE_ROWS = PAGE_ELEMENTS + ", parse_error STRING"


def error_text(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def parsed(files: DataFrame, rows_of: Callable[[object, bytes], Iterator[tuple]], columns: str, mode: str = "permissive") -> DataFrame:
    """doc_id and ``columns``: the rows that rows_of(doc_id, content) gives of each file; its error in a last column for it."""
    if mode not in ("permissive", "failfast"):
        raise ValueError(f"mode is permissive or failfast, not {mode!r}")
    out = T.StructType([files.schema["doc_id"], *schema(columns)])
    arrow = to_arrow_schema(out)
    names, types = arrow.names, arrow.types
    told = names[-1] == "parse_error"

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for part in batches:
            for k in range(part.num_rows):
                doc, content = part.column(0)[k].as_py(), part.column(1)[k].as_py()
                if content is None:
                    content = b""
                try:
                    for row in rows_of(doc, content):
                        rows.append((doc, *row))
                        if len(rows) >= OUT_ROWS:
                            yield batch(rows)
                            rows = []
                except BROKEN as e:
                    if mode == "failfast":
                        raise
                    if told:
                        rows.append((doc, *[None] * (len(names) - 2), error_text(e)))
        if rows:
            yield batch(rows)

    return files.select("doc_id", "content").mapInArrow(run, out)


def by_page(pages_: list, width: int, mode: str, rows_of: Callable[[object], Iterator[tuple]]) -> Iterator[tuple]:
    """The rows of each page, with no error; of a page that can't be read one row of ``width``, with its number and error."""
    for p in pages_:
        try:
            rows = [(*r, None) for r in rows_of(p)]
        except BROKEN as e:
            if mode == "failfast":
                raise
            rows = [(p.number, *[None] * (width - 2), error_text(e))]
        yield from rows


def as_variant(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.parse_json(c) for c in columns})


def headers(files: DataFrame, mode: str = "permissive") -> DataFrame:
    """One row a file: version, number of pages, and what went wrong, if anything."""

    def rows(doc, content):
        try:
            version = header_version(content)
            yield version, len(Document(content).pages), None
        except BROKEN as e:
            if mode == "failfast":
                raise
            known = content[5:8].decode("ascii", "replace") if content[:5] == b"%PDF-" else None
            yield known, None, error_text(e)

    return parsed(files, rows, HEADERS, mode)


def versions(files: DataFrame) -> DataFrame:
    """doc_id and version from the first eight bytes, in native expressions; null where there is no header."""
    good = F.expr("substring(content, 1, 5) = X'255044462D'")
    return files.select("doc_id", F.when(good, F.decode(F.expr("substring(content, 6, 3)"), "US-ASCII")).alias("version"))


def token_columns(kind: str, value) -> tuple:
    """(i, r, s, b, bool) of a token's value."""
    if isinstance(value, bool):
        return None, None, None, None, value
    if isinstance(value, int):
        return (value if abs(value) <= INT_MAX else None), None, None, None, None
    if isinstance(value, float):
        return None, value, None, None, None
    if isinstance(value, bytes):
        return None, None, None, value, None
    return None, None, None if value is None else str(value), None, None


def tokens(files: DataFrame, mode: str = "permissive") -> DataFrame:
    def rows(doc, content):
        for seq, t in enumerate(tokenize(content)):
            yield (seq, t.kind, *token_columns(t.kind, t.value), t.offset)

    return parsed(files, rows, TOKENS, mode)


def xref(files: DataFrame, mode: str = "permissive") -> DataFrame:
    """Entries of all sections, the newest section being 0."""

    def rows(doc, content):
        for k, section in enumerate(Document(content).sections):
            for e in section.entries.values():
                yield k, e.number, e.offset, e.generation, e.free, e.kind, e.stream_number, e.index

    return parsed(files, rows, XREF, mode)


def merged_xref(entries: DataFrame) -> DataFrame:
    """The newest entry of each object: older sections only fill gaps."""
    newest = Window.partitionBy("doc_id", "obj_num").orderBy("section")
    return entries.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def object_offsets(entries: DataFrame) -> DataFrame:
    """merged_xref with offset null where an object is free or in an object stream."""
    return merged_xref(entries).withColumn("offset", F.when(~F.col("free") & (F.col("entry_type") != 2), F.col("offset")))


def trailer(files: DataFrame, mode: str = "permissive") -> DataFrame:
    """Trailer keys of all sections, values as VARIANT."""

    def rows(doc, content):
        for k, section in enumerate(Document(content).sections):
            for key, value in section.trailer.items():
                yield k, str(key), to_json(value)

    return as_variant(parsed(files, rows, TRAILER, mode), "value")


def trailer_summary(entries: DataFrame) -> DataFrame:
    """One row a file: root and info as (number, generation), and the size (0 if there is none), from the newest that has them."""
    newest = Window.partitionBy("doc_id", "key").orderBy("section")
    keys = entries.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1")
    ref = lambda key: F.max(F.when(F.col("key") == key, F.struct(F.try_variant_get("value", "$.ref[0]", "bigint").alias("obj"), F.try_variant_get("value", "$.ref[1]", "int").alias("gen"))))
    size = F.max(F.when(F.col("key") == "Size", F.try_variant_get("value", "$", "bigint")))
    return keys.groupBy("doc_id").agg(ref("Root").alias("root"), ref("Info").alias("info"), F.coalesce(size, F.lit(0)).alias("size"))


def objects(files: DataFrame, mode: str = "permissive", decode: bool = False) -> DataFrame:
    """All objects that aren't free; a stream's value is its dictionary, its bytes as they stand or decoded."""

    def rows(doc, content):
        d = opened(content)
        for n, e in sorted(d.entries.items()):
            if e.free:
                continue
            try:
                value = d.object(n, e.generation)
                stream = isinstance(value, Stream)
                data = (d.decoded(value) if decode else value.data) if stream else None
                row = n, e.generation, kind_of(value), to_json(value.dictionary if stream else value), data, value.offset if stream else d.offset_of(n), None
            except BROKEN as error:
                if mode == "failfast":
                    raise
                row = n, e.generation, None, None, None, d.offset_of(n), error_text(error)
            yield row

    return as_variant(parsed(files, rows, OBJECTS, mode), "value")


def pages(files: DataFrame, start: int = 0, end: int | None = None, contents: bool = True, mode: str = "permissive", extensions: Extensions = NONE) -> DataFrame:
    """Pages from start (0-based) to before end: size, box, resources as VARIANT, decoded content (null if there is none)."""
    check_range(start, end)
    width = len(schema(PAGES))

    def rows(doc, content):
        d = opened(content, extensions.filters)

        def row(p):
            b = p.media_box
            yield p.number, b[2] - b[0], b[3] - b[1], b, to_json(p.resources), d.contents(p) if contents else None

        yield from by_page(d.pages[start:end], width, mode, row)

    return as_variant(parsed(files, rows, PAGES, mode), "resources")


def check_range(start: int, end: int | None) -> None:
    if start < 0 or end is not None and end < 0:
        raise ValueError("pages are numbered from 0: start and end must not be negative")


def page_tree(objects_table: DataFrame, trailer_table: DataFrame) -> DataFrame:
    """doc_id, page_number, obj_num of the pages, by joins over the tables of objects and trailers: the tree level by level.

    Each level is a join and a checkpoint, however many levels and nodes there are. Paths of kid numbers order the
    pages; an object above itself is not entered again. For references only.
    """
    root = trailer_summary(trailer_table).select("doc_id", F.col("root.obj").alias("obj_num"))
    nodes = objects_table.filter("kind = 'dictionary'").select("doc_id", "obj_num", F.try_variant_get("value", "$.Type.n", "string").alias("type"), F.try_variant_get("value", "$.Pages.ref[0]", "bigint").alias("tree"), F.try_variant_get("value", "$.Kids", "array<struct<ref: array<bigint>>>").alias("kids"))
    nodes = checkpointed(nodes)
    tops = root.join(nodes, ["doc_id", "obj_num"]).select("doc_id", F.col("tree").alias("obj_num"))
    level = tops.withColumns({"path": F.array().cast("array<int>"), "above": F.array().cast("array<bigint>")})
    found = None
    while True:
        level = checkpointed(level.join(nodes.drop("tree"), ["doc_id", "obj_num"]))
        leaves = level.filter("type = 'Page'").select("doc_id", "obj_num", "path")
        found = found.unionByName(leaves) if found else leaves
        inner = level.filter("type = 'Pages'")
        if inner.isEmpty():
            break
        kids = inner.select("doc_id", F.posexplode("kids").alias("_place", "_kid"), "path", F.array_append("above", F.col("obj_num")).alias("above"))
        kids = kids.select("doc_id", F.col("_kid.ref")[0].alias("obj_num"), F.array_append("path", F.col("_place")).alias("path"), "above")
        level = kids.filter("NOT array_contains(above, obj_num)")
    return found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")).alias("page_number"), "obj_num")


def encoders(document: Document, page, doc_id, extensions: Extensions) -> Callable[[str], FontEncoder | None]:
    """A page's fonts by name; a resolver of the user's goes first."""
    known = page_encoders(document, page)

    def find(name: str) -> FontEncoder | None:
        own = extensions.font_resolver(doc_id, name) if extensions.font_resolver else None
        return own or known(name)

    return find


def fonts(files: DataFrame, start: int = 0, end: int | None = None, mode: str = "permissive") -> DataFrame:
    check_range(start, end)
    width = len(schema(FONTS))

    def rows(doc, content):
        d = opened(content)

        def each(p):
            for name, font in d.fonts(p).items():
                e = encoder_of(font, d)
                yield p.number, str(name), list(e.widths.items()), e.encoding, list(e.differences.items()), list(e.to_unicode.items())

        yield from by_page(d.pages[start:end], width, mode, each)

    return parsed(files, rows, FONTS, mode)


def operators(files: DataFrame, start: int = 0, end: int | None = None, mode: str = "permissive") -> DataFrame:
    """Content operators in order, operands as VARIANT."""
    check_range(start, end)
    width = len(schema(OPERATORS))

    def rows(doc, content):
        d = opened(content)

        def each(p):
            for seq, o in enumerate(content_operators(d.contents(p) or b"")):
                yield p.number, seq, o.name, to_json(o.operands), o.offset

        yield from by_page(d.pages[start:end], width, mode, each)

    return as_variant(parsed(files, rows, OPERATORS, mode), "operands")


def page_rows(files: DataFrame, start: int = 0, end: int | None = None, geometry: str = "compatible", decoding: str = "heuristic", mode: str = "permissive", extensions: Extensions = NONE) -> DataFrame:
    """One row a page with its size and an array of its text elements: file to elements in one hop, pages without text too.

    A page that can't be read has its number, nulls and parse_error; a file that can't be read has one such row.
    """
    check_range(start, end)
    width = len(schema(PAGE_ROWS))

    def rows(doc, content):
        d = opened(content, extensions.filters)

        def row(p):
            data = d.contents(p)
            found = page_elements(data, encoders(d, p, doc, extensions), geometry=geometry, decoding=decoding, extra=extensions.operators) if data else []
            b = p.media_box
            yield p.number, b[2] - b[0], b[3] - b[1], [dict(e._asdict(), seq=k) for k, e in enumerate(found)]

        yield from by_page(d.pages[start:end], width, mode, row)

    return parsed(files, rows, PAGE_ROWS, mode)


def elements(files: DataFrame, **how) -> DataFrame:
    """The fact table: a row for each text element, in order of seq within (doc_id, page_number). Errors are in page_rows."""
    return page_rows(files, **how).select("doc_id", "page_number", F.inline("elements"))


def with_bbox(df: DataFrame) -> DataFrame:
    return df.withColumn("bbox", F.array("x", "y", F.col("x") + F.col("width"), F.col("y") + F.col("height")))


def metadata(files: DataFrame, mode: str = "permissive") -> DataFrame:
    def rows(doc, content):
        yield from ((str(k), v) for k, v in opened(content).metadata.items())

    return parsed(files, rows, METADATA, mode)


def stream_filters(files: DataFrame, mode: str = "permissive") -> DataFrame:
    """obj_num, filters and decoded length of each stream."""

    def rows(doc, content):
        d = opened(content)
        for e, value in d.all_objects():
            if isinstance(value, Stream):
                yield e.number, [str(n) for n in filter_names(d.resolve(value.get("Filter")))], len(d.decoded(value))

    return parsed(files, rows, "obj_num BIGINT, filters ARRAY<STRING>, decoded_length BIGINT", mode)


def resolved(refs: DataFrame, objects_table: DataFrame) -> DataFrame:
    """refs (doc_id, obj_num, ...) with kind, value and stream_data of the objects that they name; null where there is none."""
    found = objects_table.select("doc_id", "obj_num", "kind", "value", "stream_data")
    return refs.join(found, ["doc_id", "obj_num"], "left")


def page_contents(objects_table: DataFrame, tree: DataFrame) -> DataFrame:
    """doc_id, page_number, content by joins: the pages of page_tree, their references to contents, the decoded streams.

    objects_table comes from objects(..., decode=True). Parts are parted by a line end where they lack one; empty parts
    are left out. A page without contents has none.
    """
    pages_ = resolved(tree, objects_table)
    one = F.try_variant_get("value", "$.Contents.ref[0]", "bigint")
    many = F.transform(F.try_variant_get("value", "$.Contents", "array<struct<ref: array<bigint>>>"), lambda r: r["ref"][0])
    refs = pages_.select("doc_id", "page_number", F.posexplode_outer(F.coalesce(F.when(one.isNotNull(), F.array(one)), many)).alias("part", "obj_num"))
    parts = resolved(refs, objects_table.filter("kind = 'stream'"))
    gathered = parts.groupBy("doc_id", "page_number").agg(F.count("obj_num").alias("_n"), F.sort_array(F.collect_list(F.when(F.octet_length("stream_data") > 0, F.struct("part", "stream_data")))).alias("_parts"))
    joined = F.expr("aggregate(_parts, CAST('' AS BINARY), (a, s) -> concat(a, IF(substring(s.stream_data, -1, 1) = X'0A', s.stream_data, concat(s.stream_data, X'0A'))))")
    single = F.when(F.size("_parts") > 0, F.element_at("_parts", 1)["stream_data"]).otherwise(F.lit(b""))
    return gathered.select("doc_id", "page_number", F.when(F.col("_n") == 1, single).when(F.col("_n") > 1, joined).alias("content"))
