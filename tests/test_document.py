import zlib

import pytest

from sheafwork.functions.document import Document, startxref
from sheafwork.functions.values import Name, ParseError, Ref, Stream
from sheafwork.functions.writer import Writer, simple_pdf, text_lines


def text_of(document):
    from sheafwork.functions.content import page_elements

    return [[e.text for e in page_elements(document.contents(p) or b"")] for p in document.pages]


def test_minimal_file():
    d = Document(simple_pdf([b""]))
    assert d.version == "1.4" and len(d.pages) == 1 and d.pages[0].media_box == [0, 0, 612, 792]
    assert d.contents(d.pages[0]) is None and d.trailer["Root"] == Ref(1, 0) and d.trailer["Size"] == 5 and d.metadata == {}


@pytest.mark.parametrize("line_end", [b"\n", b"\r\n"])
def test_stream_line_ends_and_indirect_length(line_end):
    body = zlib.compress(b"BT (Hello) Tj ET")
    data = simple_pdf([b"X"]).replace(b"stream\nX\n", b"stream" + line_end + body + b"\n").replace(b"/Length 1", b"/Length 9 0 R /Filter /FlateDecode")
    assert text_of(Document(rebuilt(data))) == [["Hello"]]


def rebuilt(data: bytes) -> bytes:
    """The file with a new cross-reference table for the places where its objects now are."""
    import re

    at = {int(m[1]): m.start() for m in re.finditer(rb"(?m)^(\d+) 0 obj", data)}
    head = data[: data.rindex(b"xref\n0 1")] if b"xref\n0 1" in data else data
    table = b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % kv for kv in sorted(at.items()))
    return head + table + b"trailer\n<</Root 1 0 R /Size 9>>\nstartxref\n%d\n%%%%EOF" % len(head)


def test_errors():
    with pytest.raises(ParseError):
        Document(b"GIF89a and no more").version  # noqa: B018
    with pytest.raises(ParseError):
        Document(b"").version  # noqa: B018
    with pytest.raises(ValueError):
        Document(b"%PDF-1.4\n1 0 obj\n<</A 1>>\nendobj\n").pages  # noqa: B018
    with pytest.raises(ValueError):
        startxref(b"startxref\n12\n startxref nothing")
    no_root = b"%PDF-1.4\nxref\n0 0\ntrailer\n<</Size 0>>\nstartxref\n9\n%%EOF"
    with pytest.raises(ParseError, match="root"):
        Document(no_root).pages  # noqa: B018


def test_prev_chain_and_free_entries():
    one = simple_pdf([text_lines("one")], info={"Title": b"1", "Author": b"A"})
    two = Writer()
    two.add({"Title": b"2"}, 6)
    second = two.update(one, Ref(1, 0), startxref(one), Ref(6, 0))
    three = Writer()
    three.add({"Title": b"3"}, 6)
    third = three.update(second, Ref(1, 0), startxref(second), Ref(6, 0))
    d = Document(third)
    assert len(d.sections) == 3 and d.metadata == {"Title": "3"} and text_of(d) == [["one"]]
    assert d.offset_of(0) is None and d.object(0) is None and d.object(99) is None and d.object(6, 1) is None


def test_prev_cycle_ends():
    one = simple_pdf([b""])
    w = Writer()
    w.add({"A": 1}, 9)
    looped = w.update(one, Ref(1, 0), len(one) + len(b"9 0 obj\n<</A 1>>\nendobj\n"))
    assert len(Document(looped).sections) == 1


def test_tree_inheritance_cycles_and_order():
    w = Writer()
    root, top, left, leaf1, leaf2 = (w.add({}) for _ in range(5))
    w.objects[root.number] = {"Type": Name("Catalog"), "Pages": top}
    w.objects[top.number] = {"Type": Name("Pages"), "Kids": [left, leaf2], "MediaBox": [0, 0, 10, 20], "Resources": {"Font": {}}}
    w.objects[left.number] = {"Type": Name("Pages"), "Kids": [leaf1, top, left], "MediaBox": [0, 0, Ref(6, 0), 40]}
    w.objects[leaf1.number] = {"Type": Name("Page"), "Contents": []}
    w.objects[leaf2.number] = {"Type": Name("Page")}
    w.add(30)
    d = Document(w.bytes(root))
    assert [(p.number, p.ref, p.media_box) for p in d.pages] == [(1, leaf1, [0, 0, 30, 40]), (2, leaf2, [0, 0, 10, 20])]
    assert d.contents(d.pages[0]) == b"" and d.pages[0].resources == {"Font": {}}


def test_content_arrays_are_joined():
    w = Writer()
    root, tree = w.add({}), w.add({})
    parts = [w.add(Stream({}, p)) for p in (b"BT", b"", b"(a) Tj\n", b"ET")]
    page = w.add({"Type": Name("Page"), "Contents": parts})
    w.objects[1], w.objects[2] = {"Type": Name("Catalog"), "Pages": tree}, {"Type": Name("Pages"), "Kids": [page]}
    d = Document(w.bytes(root))
    assert d.contents(d.pages[0]) == b"BT\n(a) Tj\nET\n"


def test_xref_stream_and_object_streams():
    inner = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[3 0 R]/Count 1>>"), (3, b"<</Type/Page/Contents 5 0 R/MediaBox[0 0 9 9]>>"), (6, b"<</Title(T)>>")]
    heads, bodies = b"", b""
    for n, body in inner:
        heads += b"%d %d " % (n, len(bodies))
        bodies += body + b" "
    data = bytearray(b"%PDF-1.5\n")
    places = {}

    def put(n, dictionary, stream):
        places[n] = len(data)
        data.extend(b"%d 0 obj\n<<%s/Length %d>>stream\r\n%s\r\nendstream\nendobj\n" % (n, dictionary, len(stream), stream))

    put(4, b"/Type/ObjStm/N 4/First %d/Filter/FlateDecode" % len(heads), zlib.compress(heads + bodies))
    put(5, b"", b"BT (packed) Tj ET")
    at = len(data)
    rows = [(0, 0, 255)] + [(2, 4, k) for k in range(3)] + [(1, places[4], 0), (1, places[5], 0), (2, 4, 3), (1, at, 0)]
    table, above = b"", bytes(4)
    for kind, a, b in rows:
        row = bytes([kind]) + a.to_bytes(2, "big") + bytes([b])
        table += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True))
        above = row
    put(7, b"/Type/XRef/W[1 2 1]/Size 8/Root 1 0 R/Info 6 0 R/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 4>>", zlib.compress(table))
    d = Document(bytes(data) + b"startxref\n%d\n%%%%EOF" % at)
    assert text_of(d) == [["packed"]] and d.metadata == {"Title": "T"} and d.pages[0].media_box == [0, 0, 9, 9]
    assert d.entries[1].kind == 2 and d.offset_of(1) is None


def test_metadata_text():
    d = Document(simple_pdf([b""], info={"Title": b"\xfe\xff" + "日本".encode("utf-16-be"), "Author": "é", "Latin": b"\xe9", "Number": 7}))
    assert d.metadata == {"Title": "日本", "Author": "é", "Latin": "é", "Number": "7"}
