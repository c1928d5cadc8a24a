"""Queries over the driver's tables, each with the SQL that says the same.

Round trips write PDF files from a table, parse them, and must give back what the table says: the SQL knows nothing of
PDF. Coordinate queries take elements from lineitem and check the native grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import writer as w
from ..functions.sql import decode_codes, decoded_string, hex_string, matrix, multiply, apply_matrix, startxref_offset
from ..functions.values import Name, Stream
from ..operators import extract, grouping, tables
from ..operators.grouping import GroupingConfig
from ..session import checkpointed
from ..sources.files import text_pdf, text_pdfs, written_pdfs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Round trips of text


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def pdf_roundtrip_text(spark, sf_dir):
    files = text_pdfs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return extract.extract_text(files).select("doc_id", "text")


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def pdf_roundtrip_tolerance(spark, sf_dir):
    files = text_pdfs(table(spark, sf_dir, "documents"), "doc_id", "text", ["FlateDecode"])
    return extract.extract_text(files, GroupingConfig(grouping_mode="tolerance")).select("doc_id", "text")


def _filtered(name: str, chain: list[str]):
    @query("SELECT p_partkey, p_name || ' ' || p_type AS text FROM part")
    def run(spark, sf_dir):
        part = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_type").alias("t"))
        rows = tables.elements(text_pdfs(part, "p_partkey", "t", chain))
        return rows.select(F.col("doc_id").alias("p_partkey"), "text")

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


_filtered("pdf_flate_roundtrip", ["FlateDecode"])
_filtered("pdf_lzw_roundtrip", ["LZWDecode"])
_filtered("pdf_ascii85_roundtrip", ["ASCII85Decode"])
_filtered("pdf_asciihex_roundtrip", ["ASCIIHexDecode"])
_filtered("pdf_runlength_roundtrip", ["RunLengthDecode"])
_filtered("pdf_filter_chain", ["ASCII85Decode", "LZWDecode", "FlateDecode", "RunLengthDecode"])


# Pages

CONVERSATION = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS page_number, coalesce(text, '') AS text FROM conversations"


def conversation_files(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    return written_pdfs(turns, "conv_id", lambda texts: w.simple_pdf([w.text_lines(t) for t in texts], ["FlateDecode"]), F.transform("turns", lambda t: t["text"]))


@query(f"SELECT conv_id, count(*) AS page_count FROM ({CONVERSATION}) GROUP BY conv_id")
def pdf_page_count(spark, sf_dir):
    return tables.headers(conversation_files(spark, sf_dir)).select(F.col("doc_id").alias("conv_id"), F.col("page_count").cast("long").alias("page_count"))


@query(f"SELECT conv_id, page_number, text FROM ({CONVERSATION}) WHERE page_number BETWEEN 2 AND 3")
def pdf_page_range(spark, sf_dir):
    rows = extract.page_results(extract.result_rows(conversation_files(spark, sf_dir), 1, 3), GroupingConfig()).filter("page_number IS NOT NULL")
    return rows.select(F.col("doc_id").alias("conv_id"), F.col("page_number").cast("long").alias("page_number"), F.col("_page.text").alias("text"))


@query(f"SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS text FROM ({CONVERSATION}) GROUP BY conv_id")
def pdf_all_text(spark, sf_dir):
    return extract.all_text(extract.extract(conversation_files(spark, sf_dir))).select(F.col("doc_id").alias("conv_id"), "text")


@query(f"SELECT conv_id, count(*) AS pages, min(page_number) AS first_page, max(page_number) AS last_page FROM ({CONVERSATION}) GROUP BY conv_id")
def pdf_page_tree_join(spark, sf_dir):
    files = conversation_files(spark, sf_dir)
    found = tables.page_tree(tables.objects(files), tables.trailer(files))
    return found.groupBy(F.col("doc_id").alias("conv_id")).agg(F.count("*").alias("pages"), F.min("page_number").cast("long").alias("first_page"), F.max("page_number").cast("long").alias("last_page"))


@query(f"SELECT conv_id, page_number, 1 AS shows, len(text) - len(replace(text, chr(10), '')) AS next_lines FROM ({CONVERSATION})")
def pdf_contents_join(spark, sf_dir):
    """Page contents by joins over the tables of objects, rather than in the parser."""
    files = conversation_files(spark, sf_dir)
    objects = checkpointed(tables.objects(files, decode=True))  # parsed once
    tree = tables.page_tree(objects, tables.trailer(files))
    text = F.col("content").cast("string")
    found = tables.page_contents(objects, tree)
    return found.select(F.col("doc_id").alias("conv_id"), F.col("page_number").cast("long").alias("page_number"), F.regexp_count(text, F.lit(r"\) Tj\n")).alias("shows"), F.regexp_count(text, F.lit(r"\) '\n")).cast("long").alias("next_lines"))


@query("SELECT s_suppkey, 'dictionary' AS root_kind, 'Catalog' AS root_type, true AS missing_is_null FROM supplier")
def pdf_resolve_references(spark, sf_dir):
    """References to objects by a left join: the root, and one that isn't there."""
    files = text_pdfs(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name")
    refs = tables.trailer_summary(tables.trailer(files)).select("doc_id", F.explode(F.array(F.col("root.obj"), F.lit(99).cast("long"))).alias("obj_num"))
    found = tables.resolved(refs, tables.objects(files))
    root = F.col("obj_num") != 99
    return found.groupBy(F.col("doc_id").alias("s_suppkey")).agg(F.max(F.when(root, F.col("kind"))).alias("root_kind"), F.max(F.when(root, F.try_variant_get("value", "$.Type.n", "string"))).alias("root_type"), F.bool_and(F.when(~root, F.col("kind").isNull())).alias("missing_is_null"))


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS page_number, l_quantity::DOUBLE AS width, round(l_extendedprice, 2) AS height FROM lineitem")
def pdf_media_box(spark, sf_dir):
    boxes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice"))).alias("lines"))
    files = written_pdfs(boxes, "l_orderkey", lambda sizes: w.simple_pdf([b""] * len(sizes), boxes=[[0, 0, float(s["a"]), float(s["b"])] for s in sizes]), F.transform("lines", lambda s: F.struct(s["l_quantity"].cast("double").alias("a"), s["l_extendedprice"].alias("b"))))
    return tables.pages(files, contents=False).select(F.col("doc_id").alias("l_orderkey"), F.col("page_number").cast("long").alias("page_number"), "width", F.round("height", 2).alias("height"))


@query("SELECT c_custkey, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, '' AS text FROM customer")
def pdf_empty_page(spark, sf_dir):
    files = written_pdfs(table(spark, sf_dir, "customer"), "c_custkey", lambda _: w.simple_pdf([b""]), F.col("c_name"))
    pages = extract.extract(files).select(F.col("doc_id").alias("c_custkey"), F.inline("pages"))
    return pages.select("c_custkey", "width", "height", "text")


# Metadata, cross-references, objects, tokens


def customer_files(spark, sf_dir, version: str = "1.4"):
    build = lambda name, segment: w.simple_pdf([w.text_lines(name)], info={"Title": name.encode(), "Subject": b"\xfe\xff" + segment.encode("utf-16-be")}, version=version)
    return written_pdfs(table(spark, sf_dir, "customer"), "c_custkey", build, F.coalesce("c_name", F.lit("")), F.coalesce("c_mktsegment", F.lit("")))


@query("SELECT c_custkey, 'Title' AS key, coalesce(c_name, '') AS value FROM customer UNION ALL SELECT c_custkey, 'Subject', coalesce(c_mktsegment, '') FROM customer")
def pdf_metadata(spark, sf_dir):
    return tables.metadata(customer_files(spark, sf_dir)).withColumnRenamed("doc_id", "c_custkey")


@query("SELECT c_custkey, coalesce(c_name, '') AS title, 'Unknown' AS author FROM customer")
def pdf_metadata_lookup(spark, sf_dir):
    found = extract.extract(customer_files(spark, sf_dir))
    return found.select(F.col("doc_id").alias("c_custkey"), F.coalesce(F.try_element_at("metadata", F.lit("Title")), F.lit("Unknown")).alias("title"), F.coalesce(F.try_element_at("metadata", F.lit("Author")), F.lit("Unknown")).alias("author"))


@query("SELECT c_custkey, '1.7' AS version FROM customer")
def pdf_version(spark, sf_dir):
    return tables.versions(customer_files(spark, sf_dir, "1.7")).withColumnRenamed("doc_id", "c_custkey")


@query("SELECT c_custkey, 7 AS entries, 1 AS free_entries, 7 AS size, 1 AS root, 6 AS info FROM customer")
def pdf_xref_entries(spark, sf_dir):
    files = customer_files(spark, sf_dir)
    counts = tables.merged_xref(tables.xref(files)).groupBy("doc_id").agg(F.count("*").cast("int").alias("entries"), F.sum(F.col("free").cast("int")).cast("int").alias("free_entries"))
    summary = tables.trailer_summary(tables.trailer(files))
    out = counts.join(summary, "doc_id")
    return out.select(F.col("doc_id").alias("c_custkey"), "entries", "free_entries", F.col("size").cast("int").alias("size"), F.col("root.obj").cast("int").alias("root"), F.col("info.obj").cast("int").alias("info"))


@query("SELECT c_custkey, true AS same FROM customer")
def pdf_startxref(spark, sf_dir):
    """The native expression, against the place of the table itself."""
    files = customer_files(spark, sf_dir)
    at = startxref_offset(F.col("content"))
    return files.select(F.col("doc_id").alias("c_custkey"), (F.substring(F.col("content"), at.cast("int") + 1, F.lit(4)) == F.lit(b"xref")).alias("same"))


def updated_pdf(status: str, priority: str) -> bytes:
    base = w.simple_pdf([w.text_lines(status)], info={"Title": status.encode(), "Author": b"first"})
    from ..functions.document import startxref

    update = w.Writer()
    update.add({"Title": priority.encode()}, 6)
    return update.update(base, w.Ref(1, 0), startxref(base), w.Ref(6, 0))


@query("SELECT o_orderkey, o_orderpriority AS title, 2 AS sections, 1 AS newest FROM orders")
def pdf_prev_update(spark, sf_dir):
    """A file and its update: what the newer section has wins, what it lacks comes from the older."""
    files = written_pdfs(table(spark, sf_dir, "orders"), "o_orderkey", updated_pdf, "o_orderstatus", "o_orderpriority")
    entries = tables.xref(files)
    title = tables.metadata(files).filter("key = 'Title'").select("doc_id", F.col("value").alias("title"))
    counts = entries.groupBy("doc_id").agg(F.countDistinct("section").cast("int").alias("sections"))
    newest = tables.merged_xref(entries).filter("section = 0").groupBy("doc_id").agg(F.count("*").cast("int").alias("newest"))
    return title.join(counts, "doc_id").join(newest, "doc_id").withColumnRenamed("doc_id", "o_orderkey")


@query("SELECT c_custkey, c_name AS string_value FROM customer")
def pdf_token_strings(spark, sf_dir):
    found = tables.tokens(text_pdfs(table(spark, sf_dir, "customer"), "c_custkey", "c_name")).filter("type = 'STRING'")
    return found.select(F.col("doc_id").alias("c_custkey"), decoded_string(F.col("b")).alias("string_value"))


@query("SELECT c_custkey, kind, n FROM customer, (VALUES ('OBJ_START', 5), ('OBJ_END', 5), ('STREAM_START', 1), ('STREAM_END', 1), ('XREF', 1), ('TRAILER', 1), ('STARTXREF', 1), ('ENDOFFILE', 1), ('STRING', 1)) AS t(kind, n)")
def pdf_token_kinds(spark, sf_dir):
    kinds = ["OBJ_START", "OBJ_END", "STREAM_START", "STREAM_END", "XREF", "TRAILER", "STARTXREF", "ENDOFFILE", "STRING"]
    found = tables.tokens(text_pdfs(table(spark, sf_dir, "customer"), "c_custkey", "c_name")).filter(F.col("type").isin(kinds))
    return found.groupBy(F.col("doc_id").alias("c_custkey"), F.col("type").alias("kind")).agg(F.count("*").cast("int").alias("n"))


@query("SELECT s_suppkey, kind, n FROM supplier, (VALUES ('dictionary', 4), ('stream', 1)) AS t(kind, n)")
def pdf_object_kinds(spark, sf_dir):
    found = tables.objects(text_pdfs(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", ["FlateDecode"]))
    return found.groupBy(F.col("doc_id").alias("s_suppkey"), "kind").agg(F.count("*").cast("int").alias("n"))


@query("SELECT doc_id, len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) AS next_lines, 1 AS shows, 1 AS fonts FROM documents")
def pdf_operator_counts(spark, sf_dir):
    found = tables.operators(text_pdfs(table(spark, sf_dir, "documents"), "doc_id", "text"))
    many = lambda op: F.sum((F.col("operator") == op).cast("int"))
    return found.groupBy("doc_id").agg(many("'").alias("next_lines"), many("Tj").cast("int").alias("shows"), many("Tf").cast("int").alias("fonts"))


@query("SELECT s_suppkey, 'FlateDecode' AS filters, len(s_name) > 0 AS decoded FROM supplier")
def pdf_stream_filters(spark, sf_dir):
    found = tables.stream_filters(text_pdfs(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", ["FlateDecode"]))
    return found.select(F.col("doc_id").alias("s_suppkey"), F.array_join("filters", ",").alias("filters"), (F.col("decoded_length") > 0).alias("decoded"))


@query("SELECT event_id, true AS failed FROM events")
def pdf_parse_errors(spark, sf_dir):
    """Files that aren't PDF: a row with the error for each, and the job lives on."""
    files = written_pdfs(table(spark, sf_dir, "events"), "event_id", lambda props: (props or "").encode(), "props")
    return tables.headers(files).select(F.col("doc_id").alias("event_id"), F.col("parse_error").isNotNull().alias("failed"))


# Fonts and positions

WIDTH = "(250 * (len(regexp_extract_all(s, ' '))) + 700 * len(regexp_extract_all(s, '[A-Z]')) + 500 * (octet_length(encode(s)) - len(regexp_extract_all(s, '[A-Z ]')))) / 1000.0"


def placed_pdf(name: str, x: float, y: float) -> bytes:
    return w.simple_pdf([b"BT /F1 12 Tf 1 0 0 1 %s %s Tm %s Tj 3 Tc %s Tj ET" % (w.written(float(x)), w.written(float(y)), w.literal(name.encode()), w.literal(name.encode()))], ["FlateDecode"])


@query(f"""
WITH t AS (SELECT s_suppkey, s_name AS s, round(s_acctbal, 2) AS x, s_nationkey::DOUBLE AS y FROM supplier),
u AS (SELECT *, round(12 * {WIDTH}, 6) AS w1, len(s) AS n FROM t)
SELECT s_suppkey, 0 AS seq, s AS text, round(x, 4) AS x, y, round(w1, 4) AS width FROM u
UNION ALL SELECT s_suppkey, 1, s, round(x + w1, 4), y, round(w1 + 3 * n, 4) FROM u
""")
def pdf_element_positions(spark, sf_dir):
    files = written_pdfs(table(spark, sf_dir, "supplier"), "s_suppkey", placed_pdf, "s_name", F.round("s_acctbal", 2), F.col("s_nationkey").cast("double"))
    e = tables.elements(files)
    return e.select(F.col("doc_id").alias("s_suppkey"), "seq", "text", F.round("x", 4).alias("x"), "y", F.round("width", 4).alias("width"))


def kerned_pdf(name: str, size: int) -> bytes:
    half = len(name) // 2
    parts = w.written([name[:half].encode(), -500, name[half:].encode()])
    return w.simple_pdf([b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 100 Tz 5 7 Td %s TJ ET Q BT /F1 %d Tf 0 50 TD T* (x) ' ET" % (parts, size)])


@query(f"""
WITH t AS (SELECT p_partkey, p_size, p_name AS a, left(p_name, len(p_name) // 2) AS s FROM part),
u AS (SELECT *, 10 * {WIDTH} AS w1 FROM t)
SELECT p_partkey, 0 AS seq, s AS text, 15.0::DOUBLE AS x, 27.0::DOUBLE AS y, round(2 * w1, 4) AS width, 10.0::DOUBLE AS height FROM u
UNION ALL SELECT p_partkey, 1, substr(a, len(s) + 1), round(15 + w1 + 5, 4), 27.0, round(2 * (SELECT 10 * {WIDTH.replace('s,', 'r,').replace('(s)', '(r)')} FROM (SELECT substr(a, len(s) + 1) AS r)), 4), 10.0 FROM u
UNION ALL SELECT p_partkey, 2, 'x', 0.0, 100.0, round(p_size * 0.5, 4), p_size::DOUBLE FROM u
""")
def pdf_kerned_array(spark, sf_dir):
    """TJ, cm, q and Q, TD, T* and ' in the compatible geometry."""
    files = written_pdfs(table(spark, sf_dir, "part"), "p_partkey", kerned_pdf, "p_name", "p_size")
    e = tables.elements(files)
    return e.select(F.col("doc_id").alias("p_partkey"), "seq", "text", F.round("x", 4).alias("x"), "y", F.round("width", 4).alias("width"), "height")


def mapped_pdf(name: str) -> bytes:
    """Codes from 1 up stand for the name's characters, by a ToUnicode map."""
    letters = sorted(set(name))
    code = {c: k + 1 for k, c in enumerate(letters)}
    chars = b"\n".join(b"<%02X> <%s>" % (k, c.encode("utf-16-be").hex().encode()) for c, k in code.items())
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange %d beginbfchar\n%s\nendbfchar" % (len(code), chars)
    doc = w.Writer()
    catalog, tree = doc.add({}), doc.add({})
    to = doc.add(Stream({}, cmap))
    font = doc.add({"Type": Name("Font"), "Subtype": Name("Type1"), "FirstChar": 1, "Widths": [1000] * len(code), "ToUnicode": to})
    content = doc.add(Stream({}, b"BT /F1 1 Tf <" + bytes(code[c] for c in name).hex().encode() + b"> Tj ET"))
    page = doc.add({"Type": Name("Page"), "Parent": tree, "Contents": content, "Resources": {"Font": {"F1": font}}})
    doc.objects[1], doc.objects[2] = {"Type": Name("Catalog"), "Pages": tree}, {"Type": Name("Pages"), "Kids": [page], "Count": 1}
    return doc.bytes(catalog)


@query("SELECT c_custkey, c_name AS text, len(c_name)::DOUBLE AS width FROM customer")
def pdf_tounicode(spark, sf_dir):
    e = tables.elements(written_pdfs(table(spark, sf_dir, "customer"), "c_custkey", mapped_pdf, "c_name"), decoding="font")
    return e.select(F.col("doc_id").alias("c_custkey"), "text", F.round("width", 6).alias("width"))


@query("SELECT c_custkey, len(list_distinct(string_split(c_name, ''))) AS codes, len(list_distinct(string_split(c_name, ''))) AS widths FROM customer")
def pdf_font_table(spark, sf_dir):
    found = tables.fonts(written_pdfs(table(spark, sf_dir, "customer"), "c_custkey", mapped_pdf, "c_name"))
    return found.select(F.col("doc_id").alias("c_custkey"), F.size("to_unicode").cast("long").alias("codes"), F.size("widths").cast("long").alias("widths"))


@query("SELECT p_partkey, p_name AS as_utf8, p_name AS as_codes, p_name AS from_hex FROM part")
def pdf_native_decoding(spark, sf_dir):
    raw = F.col("p_name").cast("binary")
    return table(spark, sf_dir, "part").select("p_partkey", decoded_string(raw).alias("as_utf8"), decode_codes(raw).alias("as_codes"), hex_string(F.concat(F.hex(raw), F.lit(">"))).cast("string").alias("from_hex"))


@query("SELECT l_orderkey, l_linenumber, round(-l_quantity * 2 + 5, 6) AS x, round(l_extendedprice * 3 + 7, 6) AS y FROM lineitem")
def matrix_algebra(spark, sf_dir):
    """A scaling that turns x about, then a translation, as columns."""
    m = multiply(multiply(matrix(), matrix(a=-2.0, d=3.0)), matrix(e=5.0, f=7.0))
    p = apply_matrix(m, F.col("l_quantity"), F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


# Coordinates from lineitem: one page an order

COORDS = """
SELECT l_orderkey AS doc_id, 1 AS page_number,
  (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1) AS seq,
  l_returnflag || l_linenumber AS text, l_extendedprice / 200 AS x, l_quantity * 1.5 AS y, len(l_returnflag || l_linenumber) * 6.0::DOUBLE AS width,
  CASE WHEN l_tax > 0.05 THEN 18.0 ELSE 12.0 END::DOUBLE AS font_size FROM lineitem"""


def coordinates(spark, sf_dir):
    from pyspark.sql.window import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    text = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    size = F.when(F.col("l_tax") > 0.05, 18.0).otherwise(12.0)
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"), (F.row_number().over(order) - 1).alias("seq"), text.alias("text"), (F.col("l_extendedprice") / 200).alias("x"), (F.col("l_quantity") * 1.5).alias("y"), (F.length(text) * 6.0).alias("width"), size.alias("height"), size.alias("font_size"))


def lines_sql(mode: str, tol: float = 5, space: float = 3) -> str:
    """CTEs that end in ``lines``: doc_id, line_no, y, text, x_start, x_end, n."""
    if mode == "tolerance":
        marked = f"marked AS (SELECT *, round_even(y / {tol}, 0) * {tol} AS ly, dense_rank() OVER (PARTITION BY doc_id ORDER BY round_even(y / {tol}, 0) DESC) AS line_no, seq AS ord FROM e)"
    else:
        marked = f"""o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -y, x, seq) AS ord FROM e),
c AS (SELECT doc_id, ord, 1 AS line_no, y AS s, 1 AS n FROM o WHERE ord = 1
  UNION ALL SELECT o.doc_id, o.ord, CASE WHEN abs(o.y - c.s / c.n) <= {tol} THEN c.line_no ELSE c.line_no + 1 END, CASE WHEN abs(o.y - c.s / c.n) <= {tol} THEN c.s + o.y ELSE o.y END, CASE WHEN abs(o.y - c.s / c.n) <= {tol} THEN c.n + 1 ELSE 1 END
  FROM c JOIN o ON o.doc_id = c.doc_id AND o.ord = c.ord + 1),
marked AS (SELECT o.*, c.line_no, avg(o.y) OVER (PARTITION BY o.doc_id, c.line_no) AS ly FROM o JOIN c USING (doc_id, ord))"""
    return f"""WITH RECURSIVE e AS ({COORDS}), {marked},
spaced AS (SELECT *, CASE WHEN x - lag(x + width) OVER (PARTITION BY doc_id, line_no ORDER BY x, ord) > {space} THEN ' ' ELSE '' END || text AS piece FROM marked),
lines AS (SELECT doc_id, line_no, any_value(ly) AS y, string_agg(piece, '' ORDER BY x, ord) AS text, min(x) AS x_start, max(x + width) AS x_end, count(*) AS n FROM spaced GROUP BY doc_id, line_no)"""


LINE = "SELECT doc_id, line_no, round(y, 6) AS y, text, round(x_start, 6) AS x_start, round(x_end, 6) AS x_end, n FROM lines"


def line_columns(df):
    return df.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.round("y", 6).alias("y"), "text", F.round("x_start", 6).alias("x_start"), F.round("x_end", 6).alias("x_end"), F.col("fragment_count").cast("long").alias("n"))


@query(lines_sql("tolerance") + LINE)
def lines_tolerance(spark, sf_dir):
    return line_columns(grouping.group_lines(coordinates(spark, sf_dir), GroupingConfig(grouping_mode="tolerance")))


@query(lines_sql("cluster") + LINE)
def lines_cluster(spark, sf_dir):
    return line_columns(grouping.group_lines(coordinates(spark, sf_dir), GroupingConfig(grouping_mode="cluster")))


@query(lines_sql("cluster", 2, 20) + LINE)
def lines_cluster_narrow(spark, sf_dir):
    return line_columns(grouping.group_lines(coordinates(spark, sf_dir), GroupingConfig(y_tolerance=2, space_width=20)))


BLOCKS = """,
g AS (SELECT *, lag(y) OVER (PARTITION BY doc_id ORDER BY line_no) - y AS gap FROM lines),
b AS (SELECT doc_id, line_no, NULL::DOUBLE AS mean, 1 AS block_no FROM g WHERE line_no = 1
  UNION ALL SELECT g.doc_id, g.line_no, CASE WHEN b.mean IS NULL THEN g.gap ELSE 0.9 * b.mean + 0.1 * g.gap END,
    b.block_no + CASE WHEN g.gap > 1.5 * CASE WHEN b.mean IS NULL THEN g.gap ELSE 0.9 * b.mean + 0.1 * g.gap END THEN 1 ELSE 0 END
  FROM b JOIN g ON g.doc_id = b.doc_id AND g.line_no = b.line_no + 1),
blocks AS (SELECT doc_id, block_no, string_agg(text, chr(10) ORDER BY line_no) AS text, count(*) AS line_count, min(x_start) AS x_start, max(x_end) AS x_end, max(y) AS y_start, min(y) AS y_end
  FROM lines JOIN b USING (doc_id, line_no) GROUP BY doc_id, block_no)
"""


@query(lines_sql("cluster", 2) + BLOCKS + "SELECT doc_id, block_no, text, line_count, round(x_start, 6) AS x_start, round(x_end, 6) AS x_end, round(y_start, 6) AS y_start, round(y_end, 6) AS y_end FROM blocks")
def text_blocks(spark, sf_dir):
    out = grouping.group_blocks(coordinates(spark, sf_dir), GroupingConfig(y_tolerance=2))
    return out.select("doc_id", F.col("block_no").cast("int").alias("block_no"), "text", F.col("line_count").cast("long").alias("line_count"), *(F.round(c, 6).alias(c) for c in ("x_start", "x_end", "y_start", "y_end")))


@query(lines_sql("cluster", 2) + BLOCKS + "SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY block_no) AS text FROM blocks GROUP BY doc_id")
def plain_text(spark, sf_dir):
    return grouping.plain_text(coordinates(spark, sf_dir), GroupingConfig(y_tolerance=2)).select("doc_id", "text")


@query(f"SELECT doc_id, string_agg(text, ' ' ORDER BY seq) AS text FROM ({COORDS}) WHERE x BETWEEN 50 AND 200 AND y BETWEEN 20 AND 60 GROUP BY doc_id")
def region_filter(spark, sf_dir):
    inside = coordinates(spark, sf_dir).filter(F.col("x").between(50, 200) & F.col("y").between(20, 60))
    return inside.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ").alias("text"))


@query(f"SELECT doc_id, seq, text, font_size FROM ({COORDS}) WHERE font_size >= 18")
def header_filter(spark, sf_dir):
    return coordinates(spark, sf_dir).filter("font_size >= 18").select("doc_id", F.col("seq").cast("long").alias("seq"), "text", "font_size")


@query(f"SELECT doc_id, seq, text FROM ({COORDS}) WHERE x < 150")
def left_column(spark, sf_dir):
    return coordinates(spark, sf_dir).filter("x < 150").select("doc_id", F.col("seq").cast("long").alias("seq"), "text")


@query(f"SELECT doc_id, round_even(y / 5, 0) * 5 AS bucket, string_agg(text, ' ' ORDER BY x, seq) AS text FROM ({COORDS}) GROUP BY 1, 2")
def y_buckets(spark, sf_dir):
    e = coordinates(spark, sf_dir).withColumn("bucket", F.rint(F.col("y") / 5) * 5)
    return e.groupBy("doc_id", "bucket").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "seq", "text"))), lambda s: s["text"]), " ").alias("text"))


@query(f"SELECT count(*) AS elements, count(DISTINCT doc_id) AS pages FROM ({COORDS})")
def total_elements(spark, sf_dir):
    return coordinates(spark, sf_dir).agg(F.count("*").alias("elements"), F.countDistinct("doc_id").alias("pages"))


@query(
    "SELECT * FROM (" + lines_sql("tolerance", 2) + "SELECT 2.0::DOUBLE AS y_tolerance, 'tolerance' AS mode, count(*) AS lines FROM lines) UNION ALL SELECT * FROM (" + lines_sql("tolerance", 10)
    + "SELECT 10.0::DOUBLE, 'tolerance', count(*) FROM lines) UNION ALL SELECT * FROM (" + lines_sql("cluster", 2) + "SELECT 2.0::DOUBLE, 'cluster', count(*) FROM lines) UNION ALL SELECT * FROM (" + lines_sql("cluster", 10) + "SELECT 10.0::DOUBLE, 'cluster', count(*) FROM lines)"
)
def parameter_sweep(spark, sf_dir):
    """Pages are gathered once; each setting folds the same arrays."""
    pages = grouping.collected(coordinates(spark, sf_dir))
    settings = [(t, m) for m in grouping.MODES for t in (2.0, 10.0)]
    counts = pages
    for k, (t, m) in enumerate(settings):
        c = GroupingConfig(y_tolerance=t, grouping_mode=m)
        counts = counts.withColumn(f"_{k}", F.size(grouping.line_slices(grouping.sorted_elements(F.col("elements"), c), c)))
    sums = counts.agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in range(len(settings))))
    rows = F.array(*(F.struct(F.lit(t).alias("y_tolerance"), F.lit(m).alias("mode"), F.col(f"_{k}").alias("lines")) for k, (t, m) in enumerate(settings)))
    return sums.select(F.inline(rows))


@query("""
SELECT c_custkey, '' AS filename, 1 AS page_count, coalesce(c_name, '') AS page_text, coalesce(c_name, '') AS first_element, 72.0::DOUBLE AS x, 1 AS n_lines, 1 AS n_blocks, 'cluster' AS mode,
  'filename,page_count,pages,metadata,grouping_config' AS keys FROM customer
""")
def pdf_result_json(spark, sf_dir):
    out = extract.extract_json(customer_files(spark, sf_dir))
    j = lambda path, kind="string": F.get_json_object("result_json", path).cast(kind)
    keys = F.array_join(F.json_object_keys("result_json"), ",")
    return out.select(
        F.col("doc_id").alias("c_custkey"), j("$.filename").alias("filename"), j("$.page_count", "int").alias("page_count"), j("$.pages[0].text").alias("page_text"), j("$.pages[0].elements[0].text").alias("first_element"),
        j("$.pages[0].elements[0].x", "double").alias("x"), F.json_array_length(j("$.pages[0].lines")).alias("n_lines"), F.json_array_length(j("$.pages[0].blocks")).alias("n_blocks"), j("$.grouping_config.grouping_mode").alias("mode"), keys.alias("keys"),
    )


@query("SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS elements, 12.0::DOUBLE AS height FROM documents")
def pdf_elements_per_document(spark, sf_dir):
    e = tables.elements(text_pdfs(table(spark, sf_dir, "documents"), "doc_id", "text", ["FlateDecode"]))
    return e.groupBy("doc_id").agg(F.count("*").alias("elements"), F.max("height").alias("height"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all text of every document, in reading order, through PDF files."""
    return pdf_roundtrip_text(spark, sf_dir)


__all__ = ["QUERIES", "SQL", "entry", "text_pdf"]
