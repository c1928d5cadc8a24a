import json

import pytest
from pyspark.sql import functions as F

from sheafwork.functions import sql
from sheafwork.functions.fonts import FontEncoder
from sheafwork.functions.writer import simple_pdf, text_lines
from sheafwork.operators import grouping, tables
from sheafwork.operators.grouping import GroupingConfig
from sheafwork.plans.corpus import PdfCorpus
from sheafwork.sources import datasource
from sheafwork.sources.files import from_bytes, read_pdf
from sheafwork.streaming.incremental import stream_elements, write_available

HELLO = simple_pdf([b"BT /F1 12 Tf 50 640 Td (Spark Rows?) Tj ET", b"", text_lines("two\nthree")], info={"Title": b"T"})


def elements(spark, rows):
    """rows: (text, x, y, width) of one page."""
    data = [("d", 1, i, t, float(x), float(y), float(w), 12.0) for i, (t, x, y, w) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id string, page_number int, seq int, text string, x double, y double, width double, height double")


def lines(df, **config):
    return [(r.text, r.y) for r in grouping.group_lines(df, GroupingConfig(**config)).orderBy("line_no").collect()]


def test_cluster_and_tolerance_goldens(spark):
    five = elements(spark, [(c, 1, y, 0) for c, y in zip("abcde", (710, 702, 700, 699, 650), strict=True)])
    assert [y for _, y in lines(five)] == pytest.approx([710, 700 + 1 / 3, 650])
    four = elements(spark, [(c, 1, y, 0) for c, y in zip("abcd", (700.2, 702.8, 699.9, 710), strict=True)])
    assert lines(four, grouping_mode="tolerance") == [("d", 710), ("b", 705), ("ac", 700)]
    assert [y for _, y in lines(elements(spark, [("a", 1, 12.5, 0), ("b", 1, 2.5, 0)]), grouping_mode="TOLERANCE")] == [10, 0]


def test_spacing(spark):
    two = [("Hello", 100, 1, 30), ("World", 145, 1, 1)]
    assert lines(elements(spark, two))[0][0] == "Hello World" and lines(elements(spark, two), space_width=20.0)[0][0] == "HelloWorld"
    assert lines(elements(spark, [("a", 0, 1, 1), ("b", 4, 1, 1)]))[0][0] == "ab"


def test_blocks(spark):
    four = elements(spark, [(str(y), 5, y, 1) for y in (700, 680, 660, 620)])
    found = grouping.group_blocks(four).orderBy("block_no").collect()
    assert [(b.text, b.line_count, b.y_start, b.y_end) for b in found] == [("700\n680\n660", 3, 700, 660), ("620", 1, 620, 620)]
    assert grouping.group_blocks(elements(spark, [("a", 1, 700, 1), ("b", 1, 200, 1)])).count() == 1
    zero = elements(spark, [("a", 0, 700, 1), ("b", 7, 690, 1)])
    assert grouping.group_blocks(zero).first().x_start == 7 and grouping.group_blocks(zero, geometry="spec").first().x_start == 0


def test_bad_settings():
    with pytest.raises(ValueError):
        GroupingConfig(grouping_mode="other")
    with pytest.raises(ZeroDivisionError):
        GroupingConfig(y_tolerance=0, grouping_mode="tolerance")


def test_extraction_and_errors(spark):
    corpus = PdfCorpus.of_bytes(spark, [("a", HELLO), ("bad", b"GIF89a and no more"), ("empty", b"")])
    text = {r.doc_id: (r.text, bool(r.parse_error)) for r in corpus.extract_text().collect()}
    assert text == {"a": ("Spark Rows?\n\n\n\ntwo\nthree", False), "bad": ("", True), "empty": ("", True)}
    row = corpus.extract(1, 2).filter("doc_id = 'a'").first()
    assert row.page_count == 3 and [p.page_number for p in row.pages] == [2] and row.metadata == {"Title": "T"} and row.filename == ""
    result = json.loads(corpus.extract_json(indent=2).filter("doc_id = 'a'").first().result_json)
    assert list(result) == ["filename", "page_count", "pages", "metadata", "grouping_config"]
    page = result["pages"][0]
    assert list(page) == ["page_number", "width", "height", "text", "elements", "lines", "blocks"]
    assert page["elements"][0] == {"text": "Spark Rows?", "x": 50, "y": 640, "width": 67.8, "height": 12, "bbox": [50, 640, 117.8, 652], "font_name": "F1", "font_size": 12, "page_number": 1}
    assert result["grouping_config"] == {"y_tolerance": 5, "x_tolerance": 5, "space_width": 3, "line_gap_threshold": 1.5, "grouping_mode": "cluster"}
    with pytest.raises(ValueError):
        corpus.extract(-1)
    with pytest.raises(Exception, match="PDF"):
        PdfCorpus(corpus.files, mode="failfast").elements().collect()


def test_kept_pages(spark):
    with PdfCorpus.of_bytes(spark, [("a", HELLO)]) as corpus:
        assert corpus.elements().count() == 3 and corpus.elements(2, 3).count() == 2
        assert [r.text for r in corpus.lines().orderBy("page_number", "line_no").collect()] == ["Spark Rows?", "two", "three"]
        assert corpus.blocks().count() == 2
    assert corpus.kept is None


def test_extensions(spark):
    files = from_bytes(spark, [("a", simple_pdf([b"/F 10 Tf (AB) Tj XX"]))])
    own = tables.Extensions(operators={"XX": lambda i, args: i.show(b"own")}, font_resolver=lambda doc, name: FontEncoder(widths={65: 100.0, 66: 200.0}))
    assert [(r.text, r.width) for r in tables.elements(files, extensions=own).collect()] == [("AB", 3.0), ("own", 15.0)]


def test_paths_data_source_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(HELLO)
    (folder / "b.pdf").write_bytes(b"broken")
    (folder / "c.txt").write_bytes(b"no")
    files = read_pdf(spark, str(folder))
    assert sorted(r.filename for r in files.collect()) == ["a.pdf", "b.pdf"]
    assert PdfCorpus.read(spark, str(folder)).extract().filter("parse_error IS NULL").first().filename == "a.pdf"
    datasource.register(spark)
    load = lambda table: spark.read.format("pdf").option("table", table).load(str(folder))
    read = lambda table: load(table).filter("parse_error IS NULL").count()
    assert read("elements") == 3 and read("headers") == 1 and read("pages") == 3 and load("elements").count() == 4
    assert load("metadata").first().value == "T" and load("tokens").filter("type = 'ENDOFFILE'").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_pdf(spark, str(tmp_path / "none")).collect()
    for _ in range(2):  # the second run finds nothing new
        query = write_available(stream_elements(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck"))
        query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_sql_functions(spark):
    sql.register(spark)
    from_bytes(spark, [("a", HELLO)]).createOrReplaceTempView("files")
    assert spark.sql("SELECT count(*) AS n FROM files f, LATERAL pdf_elements(f.content) t").first().n == 3
    assert spark.sql("SELECT t.value FROM files f, LATERAL pdf_tokens(f.content) t WHERE t.type = 'ENDOFFILE'").first().value == "%%EOF"
    assert spark.sql("SELECT t.operator FROM LATERAL pdf_operators(CAST('(a) Tj' AS BINARY)) t").first().operator == "Tj"
    assert bytes(spark.sql("SELECT pdf_decode(CAST('4849>' AS BINARY), array('ASCIIHexDecode')) AS d").first().d) == b"HI"
    assert spark.sql("SELECT parse_cmap(CAST('beginbfchar <01> <0041> endbfchar' AS BINARY)) AS m").first().m == {1: "A"}
    at = spark.table("files").select(sql.startxref_offset(F.col("content")).alias("x"), F.expr("pdf_startxref(content)").alias("y")).first()
    assert at.x == at.y > 0


def test_native_text_forms(spark):
    rows = spark.createDataFrame([(bytearray(b),) for b in (b"\xfe\xff\x00\xe9", b"\xc3\xa9", b"\xe9", b"\xfe\xff\xd8", b"")], "b binary")
    assert [r[0] for r in rows.select(sql.decoded_string(F.col("b"))).collect()] == ["﻿é", "é", "é", "þÿØ", ""]
    one = rows.limit(1).select(sql.decode_codes(F.lit(b"AB\x80"), "MacRomanEncoding", F.expr("map(65, 'fi')"), F.expr("map(66, 'z')")))
    assert one.first()[0] == "fizÄ"


def test_logger(tmp_path):
    from sheafwork.logs import configure_logger, logger

    configure_logger("debug", sink=str(tmp_path / "log"))
    logger.debug("here")
    assert "DEBUG" in (tmp_path / "log").read_text()
    configure_logger()


def test_tables_of_broken_files(spark, tmp_path):
    """One bad page: the others stay, in each way to read, and in mode failfast the job fails."""
    from sheafwork.operators import tables
    from sheafwork.plans.literal_queries import broken_file
    from sheafwork.sources import datasource

    files = [("a", broken_file("x")), ("bad", b"GIF89a and no more")]
    corpus = PdfCorpus.of_bytes(spark, files)
    assert sorted((r.doc_id, r.page_number, r.text) for r in corpus.elements().collect()) == [("a", 1, "x 1"), ("a", 3, "x 3")]
    assert sorted((r.doc_id, r.page_number or 0) for r in corpus.errors().collect()) == [("a", 2), ("bad", 0)]
    with corpus:
        assert corpus.errors().count() == 2 and corpus.lines().count() == 2
    for df in (corpus.pages(), corpus.fonts(), corpus.operators()):
        bad = {(r.doc_id, r.page_number) for r in df.filter("parse_error IS NOT NULL").collect()}
        assert ("bad", None) in bad and bad <= {("bad", None), ("a", 2)}
    with pytest.raises(Exception, match="ParseError|ValueError"):
        tables.page_rows(corpus.files, mode="failfast").collect()
    for name, data in files:
        (tmp_path / f"{name}.pdf").write_bytes(data)
    datasource.register(spark)
    rows = spark.read.format("pdf").option("table", "elements").load(str(tmp_path)).collect()
    assert sorted((r.page_number or 0, r.text, r.parse_error is None) for r in rows) == [(0, None, False), (1, "x 1", True), (2, None, False), (3, "x 3", True)]


def test_positions():
    from sheafwork.functions.content import State
    from sheafwork.functions.geometry import Matrix

    s = State(ctm=Matrix(2, 0, 0, 3, 10, 20), tm=Matrix.translation(5, 7))
    s.text.rise = 1.0
    assert s.render_position() == s.baseline_position() == (15, 27)
    assert s.render_position(True) == (20, 44) and s.baseline_position(True) == (20, 41)
    s.line = Matrix.translation(4, 9)
    s.offset_line(-2.5)
    assert s.tm == s.line == Matrix.translation(4, 6.5)
    other = s.copy()
    other.paint.line_width, other.text.rise = 9.0, 0.0
    assert s.paint.line_width == 1.0 and s.text.rise == 1.0
