"""Queries over files set down byte by byte, without the writer: what a file says is in its literals and in the SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from ..functions import sql
from ..functions.sql import apply_matrix, matrix, render_position, rotation
from ..operators import extract, tables
from ..operators.grouping import GroupingConfig
from ..sources.files import written_pdfs
from .corpus import PdfCorpus
from .queries import query, table


def assembled(bodies: list[bytes], trailer: bytes = b"", line_end: bytes = b" \n") -> bytes:
    """Objects 1, 2, ... with these bodies, a cross-reference table and a trailer whose root is object 1."""
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj %s endobj\n" % (n, body)
    table_at = len(out)
    out += b"xref\n0 %d\n" % (len(bodies) + 1) + b"0000000000 65535 f" + line_end + b"".join(b"%010d 00000 n" % p + line_end for p in places)
    return bytes(out) + b"trailer <</Root 1 0 R /Size %d %s>>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, trailer, table_at)


def stream(data: bytes, entries: bytes = b"") -> bytes:
    return b"<<%s /Length %d>> stream\n%s\nendstream" % (entries, len(data), data)


def one_page(content: bytes, entries: bytes = b"", font: bytes = b"<</Type/Font/Subtype/Type1>>", *more: bytes) -> bytes:
    """A file of one page: its content is object 4, its font F1 object 5, and more objects follow."""
    return assembled([b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>", stream(content, entries), font, *more])


def hexed(text: str) -> bytes:
    return text.encode().hex().encode()


# Cross-references


def packed_file(name: str) -> bytes:
    """Catalog, tree, page and info in an object stream; the cross-references are a stream, too."""
    inner = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Contents 6 0 R>>", b"<</Title<%s>>>" % hexed(name)]
    heads, body = b"", b""
    for n, value in enumerate(inner, 1):
        heads += b"%d %d " % (n, len(body))
        body += value + b"\n"
    out = bytearray(b"%PDF-1.5\n")
    objects_at = len(out)
    out += b"5 0 obj " + stream(zlib.compress(heads + body), b"/Type/ObjStm/N 4/First %d/Filter/FlateDecode" % len(heads)) + b" endobj\n"
    content_at = len(out)
    out += b"6 0 obj " + stream(b"BT <%s> Tj ET" % hexed(name)) + b" endobj\n"
    here = len(out)
    rows = [(0, 0, 255), *((2, 5, k) for k in range(4)), (1, objects_at, 0), (1, content_at, 0), (1, here, 0)]
    entries = b"".join(bytes([kind]) + a.to_bytes(3, "big") + bytes([b]) for kind, a, b in rows)
    out += b"7 0 obj " + stream(entries, b"/Type/XRef/W[1 3 1]/Size 8/Root 1 0 R/Info 4 0 R") + b" endobj\n"
    return bytes(out) + b"startxref\n%d\n%%%%EOF" % here


@query("SELECT c_custkey, c_name AS text, c_name AS title, 4 AS packed, 3 AS placed, 1 AS free_entries FROM customer")
def pdf_xref_stream(spark, sf_dir):
    """Object streams and cross-reference streams; offsets only of objects that stand in the file."""
    files = written_pdfs(table(spark, sf_dir, "customer"), "c_custkey", packed_file, "c_name")
    count = lambda c: F.count_if(c).cast("int")
    places = tables.object_offsets(tables.xref(files)).groupBy("doc_id").agg(count(F.col("entry_type") == 2).alias("packed"), count(F.col("offset").isNotNull()).alias("placed"), count(F.col("free")).alias("free_entries"))
    found = extract.extract(files).select("doc_id", F.col("pages")[0]["text"].alias("text"), F.col("metadata")["Title"].alias("title"))
    return found.join(places, "doc_id").withColumnRenamed("doc_id", "c_custkey")


LINE_ENDS = (b" \n", b" \r", b"\r\n")


def line_end_file(key: int, name: str) -> bytes:
    return assembled([b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[]>>", b"(" + name.encode() + b")"], line_end=LINE_ENDS[key % 3])


@query("SELECT c_custkey, 4 AS entries, 3 AS found, c_name AS value FROM customer")
def pdf_xref_line_ends(spark, sf_dir):
    files = written_pdfs(table(spark, sf_dir, "customer"), "c_custkey", line_end_file, "c_custkey", "c_name")
    entries = tables.merged_xref(tables.xref(files)).groupBy("doc_id").agg(F.count("*").cast("int").alias("entries"))
    values = tables.objects(files).groupBy("doc_id").agg(F.count("*").cast("int").alias("found"), F.max(F.when(F.col("obj_num") == 3, F.unbase64(F.try_variant_get("value", "$.b", "string")).cast("string"))).alias("value"))
    return entries.join(values, "doc_id").withColumnRenamed("doc_id", "c_custkey")


def trailer_file(key: int) -> bytes:
    """startxref leads to neither a table nor a stream: what follows the next trailer keyword counts."""
    head = b"%PDF-1.3\n% nothing here\n"
    return head + b"/Lost trailer <</Size %d/Root 7 0 R>>\nstartxref\n%d\n%%%%EOF" % (key + 10, len(head))


@query("SELECT c_custkey, c_custkey + 10 AS size, 7 AS root, 0 AS entries FROM customer")
def pdf_trailer_only(spark, sf_dir):
    files = written_pdfs(table(spark, sf_dir, "customer"), "c_custkey", trailer_file, "c_custkey")
    entries = tables.xref(files).groupBy("doc_id").agg(F.count("*").cast("int").alias("_n"))
    found = tables.trailer_summary(tables.trailer(files)).join(entries, "doc_id", "left")
    return found.select(F.col("doc_id").alias("c_custkey"), "size", F.col("root.obj").cast("int").alias("root"), F.coalesce("_n", F.lit(0)).alias("entries"))


# Pages


def inherited_file(size: int, price: float) -> bytes:
    """Box and fonts of the first page come from two levels above, through a reference; the second page has its own."""
    return assembled([
        b"<</Type/Catalog/Pages 2 0 R>>",
        b"<</Type/Pages/Kids[3 0 R 5 0 R]/Count 2/MediaBox[0 0 6 0 R 200]/Resources<</Font<</Fa 7 0 R>>>>>>",
        b"<</Type/Pages/Parent 2 0 R/Kids[4 0 R]/Count 1>>",
        b"<</Type/Page/Parent 3 0 R>>",
        b"<</Type/Page/Parent 2 0 R/MediaBox[10 20 %d 70]/Resources<</Font<</Fb 7 0 R>>>>>>" % (size + 10),
        b"%.2f" % price,
        b"<</Type/Font/Subtype/Type1/FirstChar 65/Widths[500 600 700]>>",
    ])


@query("""
SELECT p_partkey, 1 AS page_number, round(p_retailprice, 2) AS width, 200.0::DOUBLE AS height, 'Fa' AS font, 3 AS widths FROM part
UNION ALL SELECT p_partkey, 2, p_size::DOUBLE, 50.0, 'Fb', 3 FROM part
""")
def pdf_inheritance(spark, sf_dir):
    files = written_pdfs(table(spark, sf_dir, "part"), "p_partkey", inherited_file, "p_size", F.round(F.col("p_retailprice").cast("double"), 2))
    boxes = tables.pages(files, contents=False).select("doc_id", "page_number", "width", "height")
    fonts = tables.fonts(files).select("doc_id", "page_number", F.col("font_name").alias("font"), F.size("widths").alias("widths"))
    out = boxes.join(fonts, ["doc_id", "page_number"])
    return out.select(F.col("doc_id").alias("p_partkey"), "page_number", F.round("width", 2).alias("width"), "height", "font", "widths")


def parted_file(name: str) -> bytes:
    """A page whose content is four streams, one empty and one compressed."""
    return assembled([
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Contents[4 0 R 5 0 R 6 0 R 7 0 R]>>",
        stream(b"BT"), stream(b""), stream(zlib.compress(b"<%s> Tj\n" % hexed(name)), b"/Filter/FlateDecode"), stream(b"ET"),
    ])


@query("SELECT c_custkey, c_name AS text, 'BT' || chr(10) || '<' || lower(hex(encode(c_name))) || '> Tj' || chr(10) || 'ET' || chr(10) AS content FROM customer")
def pdf_content_parts(spark, sf_dir):
    files = written_pdfs(table(spark, sf_dir, "customer"), "c_custkey", parted_file, "c_name")
    contents = tables.pages(files).select("doc_id", F.col("content").cast("string").alias("content"))
    return tables.elements(files).select("doc_id", "text").join(contents, "doc_id").withColumnRenamed("doc_id", "c_custkey")


def broken_file(name: str) -> bytes:
    """Three pages; the content of the second isn't what its filter says."""
    pages = [b"<</Type/Page/Contents %d 0 R>>" % n for n in (6, 7, 8)]
    shown = [stream(b"BT <%s> Tj ET" % hexed(f"{name} {k}")) for k in (1, 3)]
    return assembled([b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R 4 0 R 5 0 R]/Count 3>>", *pages, shown[0], stream(b"\x01\xffvv~>", b"/Filter/ASCII85Decode"), shown[1]])


@query("""
SELECT c_custkey, 1 AS page_number, c_name || ' 1' AS text, false AS failed FROM customer
UNION ALL SELECT c_custkey, 2, NULL, true FROM customer
UNION ALL SELECT c_custkey, 3, c_name || ' 3', false FROM customer
""")
def pdf_broken_page(spark, sf_dir):
    """A page that can't be read costs no other page, and says so."""
    files = written_pdfs(table(spark, sf_dir, "customer"), "c_custkey", broken_file, "c_name")
    rows = PdfCorpus(files).page_rows()
    return rows.select(F.col("doc_id").alias("c_custkey"), "page_number", F.try_element_at("elements", F.lit(1))["text"].alias("text"), F.col("parse_error").isNotNull().alias("failed"))


@query("SELECT c_custkey, 2 AS elements, 1 AS errors, 1 AS operator_errors, 1 AS object_errors FROM customer")
def pdf_broken_page_tables(spark, sf_dir):
    corpus = PdfCorpus(written_pdfs(table(spark, sf_dir, "customer"), "c_custkey", broken_file, "c_name"))
    tally = lambda df, name: df.groupBy("doc_id").agg(F.count("*").cast("int").alias(name))
    out = tally(corpus.elements(), "elements").join(tally(corpus.errors(), "errors"), "doc_id")
    out = out.join(tally(corpus.operators().filter("parse_error IS NOT NULL"), "operator_errors"), "doc_id")
    return out.join(tally(corpus.objects(decode=True).filter("parse_error IS NOT NULL"), "object_errors"), "doc_id").withColumnRenamed("doc_id", "c_custkey")


# Tokens and filters


def escaped_file(name: str, segment: str) -> bytes:
    octal = b"".join(b"\\%03o" % c for c in name.encode())
    name_token = b"/" + b"".join(b"#%02X" % c for c in segment.encode())
    return b"%%PDF-1.4\n(%s\\\n) %s (\\(a\\)(b)) /#zz" % (octal, name_token)


@query("""
SELECT c_custkey, 'STRING' AS type, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'STRING', '(a)(b)' FROM customer
UNION ALL SELECT c_custkey, 'NAME', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'NAME', '#zz' FROM customer
""")
def pdf_token_escapes(spark, sf_dir):
    """Octal codes, a line that goes on, brackets, and names of #XX."""
    found = tables.tokens(written_pdfs(table(spark, sf_dir, "customer"), "c_custkey", escaped_file, "c_name", "c_mktsegment"))
    return found.filter("type IN ('STRING', 'NAME')").select(F.col("doc_id").alias("c_custkey"), "type", F.coalesce("s", F.col("b").cast("string")).alias("value"))


@query("""
SELECT c_custkey, 0 AS seq, 'gs' AS operator, c_mktsegment AS operand FROM customer UNION ALL SELECT c_custkey, 1, 'BX', NULL FROM customer
UNION ALL SELECT c_custkey, 2, 'w', '3' FROM customer UNION ALL SELECT c_custkey, 3, '*!', NULL FROM customer UNION ALL SELECT c_custkey, 4, 'EX', NULL FROM customer
""")
def pdf_operator_words(spark, sf_dir):
    """Names as operands, words that are no operators of the format, and stray brackets, which end nothing."""
    build = lambda segment: one_page(b"/%s gs BX ) > 3 w ] *! EX" % b"".join(b"#%02x" % c for c in segment.encode()))
    found = tables.operators(written_pdfs(table(spark, sf_dir, "customer"), "c_custkey", build, "c_mktsegment"))
    first = F.coalesce(F.try_variant_get("operands", "$[0].n", "string"), F.try_variant_get("operands", "$[0]", "string"))
    return found.select(F.col("doc_id").alias("c_custkey"), "seq", "operator", F.when(F.col("operator").isin("gs", "w"), first).alias("operand"))


def predicted_file(name: str) -> bytes:
    """Rows of bytes by PNG predictors: as it is, and the difference to the row above; and by TIFF's."""
    data = name.encode()
    png = zlib.compress(b"\x00" + data + b"\x02" + bytes(len(data)))
    tiff = zlib.compress(bytes((c - (data[k - 1] if k else 0)) & 255 for k, c in enumerate(data)))
    how = b"/Filter/FlateDecode/DecodeParms<</Predictor %d/Columns %d>>"
    return assembled([b"<</Type/Catalog>>", stream(png, how % (15, len(data))), stream(tiff, how % (2, len(data)))])


@query("SELECT p_partkey, p_name || p_name AS png, p_name AS tiff FROM part")
def pdf_predictors(spark, sf_dir):
    found = tables.objects(written_pdfs(table(spark, sf_dir, "part"), "p_partkey", predicted_file, "p_name"), decode=True)
    of = lambda n: F.max(F.when(F.col("obj_num") == n, F.col("stream_data").cast("string")))
    return found.groupBy(F.col("doc_id").alias("p_partkey")).agg(of(2).alias("png"), of(3).alias("tiff"))


# Text


def encoded_file(key: int) -> bytes:
    """Codes in WinAnsi, in MacRoman, and with differences."""
    fonts = [b"<</Type/Font/Subtype/Type1/Encoding/WinAnsiEncoding>>", b"<</Type/Font/Subtype/Type1/Encoding/MacRomanEncoding>>", b"<</Type/Font/Subtype/Type1/Encoding<</BaseEncoding/MacRomanEncoding/Differences[1/fi/bullet 9/uni00E9/quoteleft]>>>>"]
    k = key % 4
    shown = [(b"F1", (0x80, 0x85, 0x99, 0xE9)[k]), (b"F2", (0x80, 0x8A, 0xA5, 0xD2)[k]), (b"F3", (1, 2, 9, 10)[k]), (b"F3", 0xA5)]
    content = b"BT " + b" ".join(b"/%s 10 Tf <41%02X> Tj" % (f, c) for f, c in shown) + b" ET"
    return assembled([b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Contents 4 0 R/Resources<</Font<</F1 5 0 R/F2 6 0 R/F3 7 0 R>>>>>>", stream(content), *fonts])


@query("""
WITH t AS (SELECT p_partkey, (p_partkey % 4)::INT + 1 AS k FROM part)
SELECT p_partkey, 0 AS seq, 'A' || ['€', '…', '™', 'é'][k] AS text FROM t UNION ALL SELECT p_partkey, 1, 'A' || ['Ä', 'ä', '•', '“'][k] FROM t
UNION ALL SELECT p_partkey, 2, 'A' || ['fi', '•', 'é', '`'][k] FROM t UNION ALL SELECT p_partkey, 3, 'A•' FROM t
""")
def pdf_encodings(spark, sf_dir):
    e = tables.elements(written_pdfs(table(spark, sf_dir, "part"), "p_partkey", encoded_file, "p_partkey"), decoding="font")
    return e.select(F.col("doc_id").alias("p_partkey"), "seq", "text")


def ranged_file(name: str) -> bytes:
    """Two-byte codes: letters by a range, blanks and digits by a range with a list of texts, # by a single entry."""
    digits = b"".join(b"<%04X>" % ord(c) for c in " 0123456789")
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfrange <0001> <003A> <0041> <0100> <010A> [%s] endbfrange 1 beginbfchar <0200> <0023> endbfchar" % digits
    code = {chr(65 + k): 1 + k for k in range(58)} | {c: 0x100 + k for k, c in enumerate(" 0123456789")} | {"#": 0x200}
    shown = b"".join(b"%04X" % code[c] for c in name)
    font = b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 6 0 R/DescendantFonts[7 0 R]>>"
    return one_page(b"BT /F1 1 Tf <%s> Tj ET" % shown, b"", font, stream(cmap), b"<</Type/Font/Subtype/CIDFontType2/DW 250/W[1 58 500 512[2000]]>>")


@query("SELECT s_suppkey, s_name AS text, round(0.5 * len(regexp_extract_all(s_name, '[A-Za-z]')) + 2.0 * len(regexp_extract_all(s_name, '#')) + 0.25 * len(regexp_extract_all(s_name, '[0-9 ]')), 6)::DOUBLE AS width FROM supplier")
def pdf_bfrange(spark, sf_dir):
    files = written_pdfs(table(spark, sf_dir, "supplier"), "s_suppkey", ranged_file, "s_name")
    e = tables.elements(files, decoding="font")
    return e.select(F.col("doc_id").alias("s_suppkey"), "text", F.round("width", 6).alias("width"))


def stated_file(size: int) -> bytes:
    return one_page(b"BT /F1 %d Tf 12 TL 3 Tw 1 Tr 2 Ts 50 Tz 1 0 0 1 10 100 Tm (a b) Tj 5 1 (c d) \" ET" % size)


@query("""
SELECT p_partkey, 0 AS seq, 'a b' AS text, 10.0::DOUBLE AS x, 100.0::DOUBLE AS y, round(1.25 * p_size + 1.5, 4)::DOUBLE AS width, 0.0::DOUBLE AS char_spacing, 3.0::DOUBLE AS word_spacing, 50.0::DOUBLE AS scaling, 1 AS mode,
  round(11.5 + 1.25 * p_size, 4)::DOUBLE AS right, (100 + p_size)::DOUBLE AS top FROM part
UNION ALL SELECT p_partkey, 1, 'c d', 10.0, 88.0, round(1.25 * p_size + 4, 4), 1.0, 5.0, 50.0, 1, round(14 + 1.25 * p_size, 4), 88 + p_size FROM part
""")
def pdf_text_state(spark, sf_dir):
    """Tw, TL, Tr, Ts, Tz and ", and the box of each element."""
    e = tables.with_bbox(tables.elements(written_pdfs(table(spark, sf_dir, "part"), "p_partkey", stated_file, "p_size")))
    return e.select(F.col("doc_id").alias("p_partkey"), "seq", "text", "x", "y", F.round("width", 4).alias("width"), "char_spacing", "word_spacing", F.col("horizontal_scaling").alias("scaling"), F.col("text_render_mode").alias("mode"), F.round(F.col("bbox")[2], 4).alias("right"), F.col("bbox")[3].alias("top"))


@query("SELECT n_nationkey, c_custkey, c_name AS text, len(c_name)::DOUBLE AS width, 1 AS page_number FROM customer JOIN nation ON c_nationkey = n_nationkey")
def pdf_sql_elements(spark, sf_dir):
    """The SQL table function, which gives the widths of the file's fonts like the tables do."""
    sql.register(spark)
    people = table(spark, sf_dir, "customer")
    font = b"<</Type/Font/Subtype/Type1/FirstChar 0/Widths[%s]>>" % (b"1000 " * 256)
    files = written_pdfs(people, "c_custkey", lambda name: one_page(b"BT /F1 1 Tf <%s> Tj ET" % hexed(name), b"", font), "c_name")
    found = spark.sql("SELECT f.doc_id AS c_custkey, e.text, e.width, e.page_number FROM {files} f, LATERAL pdf_elements(f.content) e WHERE e.parse_error IS NULL", files=files)
    return found.join(people.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey").join(F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey")), "n_nationkey").select("n_nationkey", "c_custkey", "text", "width", "page_number")


# Lines and blocks


def spread_file(name: str, segment: str, x: float) -> bytes:
    """Three lines close together, one far below; the first starts at 0, which compatible bounds take for unset."""
    show = b"1 0 0 1 %s %d Tm <%s> Tj "
    lines = [(b"0", 700, name), (b"%.1f" % x, 686, segment), (b"%.1f" % (x + 9), 672, "mid"), (b"33", 500, "low")]
    return one_page(b"BT /F1 10 Tf " + b"".join(show % (at, y, hexed(t)) for at, y, t in lines) + b"ET")


@query("SELECT c_custkey, 1 AS page_number, c_name || chr(10) || c_mktsegment || chr(10) || 'mid' || chr(10) || chr(10) || 'low' AS text, 2 AS blocks, (c_nationkey + 1)::DOUBLE AS x_start, 0.0::DOUBLE AS spec_start FROM customer")
def pdf_block_text(spark, sf_dir):
    """Text by blocks, and the bounds of the first block in both geometries."""
    files = written_pdfs(table(spark, sf_dir, "customer"), "c_custkey", spread_file, "c_name", "c_mktsegment", (F.col("c_nationkey") + 1).cast("double"))
    corpus = PdfCorpus(files)
    found = extract.extract(files)
    texts = extract.block_text(found)
    sizes = found.select("doc_id", F.inline("pages")).select("doc_id", F.size("blocks").alias("blocks"), F.col("blocks")[0]["x_start"].alias("x_start"))
    spec = PdfCorpus(files, geometry="spec").blocks(GroupingConfig()).filter("block_no = 1").select("doc_id", F.col("x_start").alias("spec_start"))
    kept = corpus.lines().groupBy("doc_id").agg(F.count("*").alias("_lines")).filter("_lines = 4").select("doc_id")
    return texts.join(sizes, "doc_id").join(spec, "doc_id").join(kept, "doc_id").withColumnRenamed("doc_id", "c_custkey")


# Matrices


@query("""
SELECT l_orderkey, l_linenumber, round(l_quantity * cos(pi() / 3) - l_extendedprice * sin(pi() / 3), 3) AS x, round(l_quantity * sin(pi() / 3) + l_extendedprice * cos(pi() / 3), 3) AS y,
  round(2 * l_quantity + 10, 3)::DOUBLE AS at_x, round(3 * l_extendedprice + 20, 3)::DOUBLE AS at_y FROM (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice FROM lineitem)
""")
def matrix_turns(spark, sf_dir):
    """A sixth of a turn, and where text is shown: a scaling of the page's, then its place."""
    q, p = F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")
    turned = apply_matrix(rotation(F.pi() / 3), q, p)
    at = render_position(matrix(e=q, f=p), matrix(a=2.0, d=3.0, e=10.0, f=20.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(turned["x"], 3).alias("x"), F.round(turned["y"], 3).alias("y"), F.round(at["x"], 3).alias("at_x"), F.round(at["y"], 3).alias("at_y"))
