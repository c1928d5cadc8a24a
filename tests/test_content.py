import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sheafwork.functions.content import Interpreter, operators, page_elements
from sheafwork.functions.fonts import MAC_ROMAN, WIN_ANSI, CMap, FontEncoder, glyph_text, parse_encoding
from sheafwork.functions.geometry import IDENTITY, Matrix
from sheafwork.functions.values import Name


def shown(data, **how):
    return [(e.text, round(e.x, 6), round(e.y, 6), round(e.width, 6)) for e in page_elements(data, **how)]


def test_hello():
    (e,) = page_elements(b"BT\n/F1 12 Tf\n50 640 Td\n(Spark Rows?) Tj\nET")
    assert (e.text, e.x, e.y, e.font_name, e.font_size, e.height) == ("Spark Rows?", 50, 640, "F1", 12, 12)
    assert e.width == pytest.approx(67.8) and e.bbox == pytest.approx((50, 640, 117.8, 652))


def test_strings_are_no_operators():
    assert [t for t, *_ in shown(b"(q) Tj (Q) Tj <71> Tj () Tj (BT) Tj")] == ["q", "Q", "q", "", "BT"]


def test_positions():
    assert shown(b"/F 10 Tf 14 TL 1 0 0 1 5 50 Tm (a) Tj T* (b) Tj (c) ' 2 1 (d e) \"") == [("a", 5, 50, 5), ("b", 5, 36, 5), ("c", 5, 22, 5), ("d e", 5, 8, 17.5)][:3] + [("d e", 5, 8, 10 * 1.25 + 3 * 1 + 2)]
    assert shown(b"/F 10 Tf 0 7 TD (a) Tj 1 1 Td (b) Tj") == [("a", 0, 7, 5), ("b", 6, 8, 5)]
    assert shown(b"/F 10 Tf [(a) -1000 (b)] TJ") == [("a", 0, 0, 5), ("b", 15, 0, 5)]
    assert shown(b"/F 10 Tf 50 Tz 2 Tc (ab) Tj") == [("ab", 0, 0, 12)]


def test_saved_state_and_transformations():
    assert shown(b"/F 10 Tf q 2 0 0 2 1 1 cm (a) Tj Q (b) Tj Q Q") == [("a", 1, 1, 10), ("b", 0, 0, 5)]
    assert shown(b"/F 10 Tf 2 0 0 2 1 1 cm 1 0 0 1 3 4 Tm (a) Tj") == [("a", 4, 5, 10)]
    assert shown(b"/F 10 Tf 2 0 0 2 1 1 cm 1 0 0 1 3 4 Tm (a) Tj", geometry="spec") == [("a", 7, 9, 10)]
    assert shown(b"/F 1 Tf 10 0 0 10 0 0 Tm 5 Ts 1 1 Td (a) Tj", geometry="spec") == [("a", 10, 60, 5)]


def test_bad_operands_have_no_effect():
    assert shown(b"/F 10 Tf (x) Td 1 Td cm 1 2 cm Tj [] TJ 5 TJ (ok) Tj )>]} 1-2 (end) Tj") == [("ok", 0, 0, 10), ("end", 10, 0, 15)]


def test_inline_images_are_passed_over():
    assert shown(b"/F 10 Tf BI /W 1 ID (((\x00 BT (no) Tj EI (yes) Tj") == [("yes", 0, 0, 15)]


def test_operators_and_operands():
    found = list(operators(b"1 [2 (a) [/N]] << /A 1 >> % c\n Do true null gs"))
    assert [(o.name, o.operands) for o in found] == [("Do", [1, [2, b"a", [Name("N")]]]), ("gs", [True, None])]


@given(st.binary(max_size=300))
def test_any_content_ends(data):
    page_elements(data)


def test_text_decoding():
    assert [t for t, *_ in shown(b"<FEFF00E9> Tj <C3A9> Tj <E9> Tj <FEFFD8> Tj")] == ["﻿é", "é", "é", "þÿØ"]


def test_extension_operator():
    i = Interpreter(extra={"XX": lambda interpreter, args: interpreter.show(b"own")})
    assert [e.text for e in i.run(b"XX")] == ["own"]


def test_matrices():
    m = Matrix.rotation(math.pi / 2) * Matrix.translation(1, 2)
    assert m.point(1, 0) == pytest.approx((1, 3)) and m.vector(1, 0) == pytest.approx((0, 1))
    assert Matrix.scaling(2, 3) * IDENTITY == Matrix.scaling(2, 3) == Matrix.of([2, 0, 0, 3, 0, 0])
    with pytest.raises(ValueError):
        Matrix.of([1, 2])


def test_encodings():
    assert len(WIN_ANSI) == len(MAC_ROMAN) == 256
    assert WIN_ANSI[0x80] == "€" and WIN_ANSI[0x81] == "\x81" and MAC_ROMAN[0x80] == "Ä" and MAC_ROMAN[0xDB] == "€"
    assert glyph_text("fi") == "fi" and glyph_text("quoteleft") == "`" and glyph_text("uni00E9") == "é" and glyph_text("nothing") is None
    assert parse_encoding({"Differences": [65, Name("B"), Name("C"), 1, Name("fi")]}) == ("WinAnsiEncoding", {65: "B", 66: "C", 1: "fi"})


def test_encoder_priority():
    e = FontEncoder("MacRomanEncoding", {65: "B", 66: "strange"}, {67: "map"}, {65: 10.0})
    assert e.decode_string(b"ABC\x80") == "BBmapÄ" and e.decode(300) == "�" and FontEncoder("Other").decode(200) == "È"
    assert e.width(65) == 10 and e.width(1) == 500


def test_cmaps():
    m = CMap(b"""1 begincodespacerange <00> <FF> endcodespacerange
      2 beginbfchar <01> <0041> <02> <D83DDE00> endbfchar
      3 beginbfrange <10> <12> <0061> <20> <21> [<0066006C> <0062>] <30> <30> <E9> endbfrange ) > ] stray""")
    assert m.spaces == [(b"\x00", b"\xff")]
    assert m.text == {1: "A", 2: "😀", 16: "a", 17: "b", 18: "c", 32: "fl", 33: "b", 48: "é"}
    two = CMap(b"begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange")
    assert list(two.codes(b"\x01\x81\x02\x03", 1)) == [b"\x01", b"\x81\x02", b"\x03"]
