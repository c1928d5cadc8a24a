"""SQL names for the byte-level functions: scalar functions and table functions, registered with a session."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .codecs import decode_filters
from .content import operators, page_elements
from .document import Document, startxref
from .fonts import GLYPHS, MAC_ROMAN, WIN_ANSI, CMap, page_encoders
from .lexer import tokenize
from .values import to_json


def decoded_string(raw: Column) -> Column:
    """Text of a shown string in native expressions: UTF-16 by its mark (kept), UTF-8 if valid, else Latin-1."""
    as_text = raw.cast("string")
    body = F.expr("X'FEFF'")
    marked = (F.substring(F.hex(raw), 1, 4) == "FEFF") & (F.octet_length(raw) % 2 == 0)
    return F.when(marked, F.concat(F.lit("﻿"), F.decode(F.concat(body, F.unhex(F.substring(F.hex(raw), 5, 1 << 30))), "UTF-16"))).when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(raw, "ISO-8859-1"))


def startxref_offset(content: Column) -> Column:
    """The offset after the last startxref of a file's last 1024 bytes, in native expressions; null if there is none."""
    tail = F.decode(F.substring(content, -1024, 1024), "ISO-8859-1")
    last = F.element_at(F.split(tail, "startxref"), -1)
    return F.when(F.contains(tail, F.lit("startxref")), F.regexp_extract(last, "^[ \\t\\r\\n\\x00\\f]*([0-9]+)", 1).try_cast("bigint"))


def hex_string(text: Column) -> Column:
    """The bytes of a valid hex string, native: up to >, blanks left out, an odd end padded."""
    digits = F.regexp_replace(F.regexp_extract(text, "^[^>]*", 0), "\\s", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def code_map(table: dict[int, str]) -> Column:
    """A map column of a fixed table of 256 codes or fewer."""
    return F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*map(F.lit, table.values())))


def decode_codes(raw: Column, encoding: str = "WinAnsiEncoding", differences: Column | None = None, to_unicode: Column | None = None) -> Column:
    """Text of one-byte codes, native: map, known difference, base encoding, Latin-1; the first that is there."""
    base = {"WinAnsiEncoding": WIN_ANSI, "MacRomanEncoding": MAC_ROMAN}.get(encoding)

    def one(i: Column) -> Column:
        code = F.conv(F.hex(raw).substr(2 * i - 1, F.lit(2)), 16, 10).cast("int")
        choices = [to_unicode[code]] if to_unicode is not None else []
        if differences is not None:
            choices.append(F.try_element_at(code_map_of_names(), differences[code]))
        if base:
            choices.append(F.try_element_at(code_map(base), code))
        return F.coalesce(*choices, F.decode(F.unhex(F.hex(raw).substr(2 * i - 1, F.lit(2))), "ISO-8859-1"))

    return F.when(F.octet_length(raw) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length(raw)), one), ""))


def code_map_of_names() -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, GLYPHS)), F.array(*map(F.lit, GLYPHS.values())))


def apply_matrix(matrix: Column, x: Column, y: Column) -> Column:
    """The point (x, y) through a struct of a, b, c, d, e, f, native."""
    m = {k: matrix[k] for k in "abcdef"}
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def multiply(m: Column, n: Column) -> Column:
    """The product of two matrix structs that applies m first, native."""
    return F.struct(
        (m["a"] * n["a"] + m["b"] * n["c"]).alias("a"), (m["a"] * n["b"] + m["b"] * n["d"]).alias("b"),
        (m["c"] * n["a"] + m["d"] * n["c"]).alias("c"), (m["c"] * n["b"] + m["d"] * n["d"]).alias("d"),
        (m["e"] * n["a"] + m["f"] * n["c"] + n["e"]).alias("e"), (m["e"] * n["b"] + m["f"] * n["d"] + n["f"]).alias("f"),
    )


def matrix(a=1.0, b=0.0, c=0.0, d=1.0, e=0.0, f=0.0) -> Column:
    """A matrix struct of columns or numbers; with none, the identity."""
    return F.struct(*((v if isinstance(v, Column) else F.lit(float(v))).alias(k) for k, v in zip("abcdef", (a, b, c, d, e, f), strict=True)))


def rotation(angle: Column) -> Column:
    return matrix(F.cos(angle), F.sin(angle), -F.sin(angle), F.cos(angle))


def render_position(ctm: Column, text: Column) -> Column:
    """Where text at a text matrix is shown, native: the transformation first, then the text matrix, as in extraction."""
    return apply_matrix(multiply(ctm, text), F.lit(0.0), F.lit(0.0))


def safe(f):
    """f of each value; null where the value is null or can't be read."""

    def run(*columns):
        out = []
        for values in zip(*(c.to_pylist() for c in columns), strict=True):
            try:
                out.append(None if values[0] is None else f(*values))
            except Exception:
                out.append(None)
        return out

    return run


def register(spark: SparkSession) -> None:
    """Registers pdf_decode, pdf_startxref, parse_cmap, and the table functions pdf_tokens, pdf_operators, pdf_elements."""

    @F.arrow_udf("binary")
    def pdf_decode(data: pa.Array, filters: pa.Array) -> pa.Array:
        return pa.array(safe(lambda d, f: decode_filters(d, list(f or [])))(data, filters), pa.binary())

    @F.arrow_udf("bigint")
    def pdf_startxref(content: pa.Array) -> pa.Array:
        return pa.array(safe(startxref)(content), pa.int64())

    @F.arrow_udf("map<int, string>")
    def parse_cmap(data: pa.Array) -> pa.Array:
        return pa.array(safe(lambda d: list(CMap(d).text.items()))(data), pa.map_(pa.int32(), pa.string()))

    @F.udtf(returnType="seq BIGINT, type STRING, value STRING, offset BIGINT")
    class PdfTokens:
        def eval(self, content: bytes):
            for seq, t in enumerate(tokenize(bytes(content or b""))):
                value = t.value.decode("latin-1") if isinstance(t.value, bytes) else t.value
                yield seq, t.kind, None if value is None else str(value), t.offset

    @F.udtf(returnType="seq INT, operator STRING, operands STRING, offset BIGINT")
    class PdfOperators:
        def eval(self, content: bytes):
            for seq, o in enumerate(operators(bytes(content or b""))):
                yield seq, o.name, to_json(o.operands), o.offset

    @F.udtf(returnType="page_number INT, seq INT, text STRING, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, font_name STRING, font_size DOUBLE, parse_error STRING")
    class PdfElements:
        def eval(self, content: bytes):
            d, nothing = Document(bytes(content or b"")), [None] * 8
            try:
                pages = d.pages
            except Exception as e:
                yield None, *nothing, f"{type(e).__name__}: {e}"
                return
            for p in pages:
                try:
                    found = page_elements(d.contents(p) or b"", page_encoders(d, p))
                except Exception as e:
                    yield p.number, *nothing, f"{type(e).__name__}: {e}"
                    continue
                for seq, e in enumerate(found):
                    yield p.number, seq, e.text, e.x, e.y, e.width, e.height, e.font_name, e.font_size, None

    for name, f in (("pdf_decode", pdf_decode), ("pdf_startxref", pdf_startxref), ("parse_cmap", parse_cmap)):
        spark.udf.register(name, f)
    for name, f in (("pdf_tokens", PdfTokens), ("pdf_operators", PdfOperators), ("pdf_elements", PdfElements)):
        spark.udtf.register(name, f)
