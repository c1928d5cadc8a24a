"""A small deterministic PDF writer, for fixtures and round trips."""

from __future__ import annotations

from .codecs import encode_filters
from .values import Name, Ref, Stream


def literal(data: bytes) -> bytes:
    """A literal string; only what must be escaped is."""
    for plain, escaped in ((b"\\", b"\\\\"), (b"(", b"\\("), (b")", b"\\)"), (b"\r", b"\\r"), (b"\n", b"\\n")):
        data = data.replace(plain, escaped)
    return b"(" + data + b")"


def written(value) -> bytes:
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"#()<>[]{}/%" else b"#%02X" % c for c in value.encode())
    if isinstance(value, Ref):
        return b"%d %d R" % value
    if isinstance(value, (bytes, bytearray)):
        return literal(bytes(value))
    if isinstance(value, str):
        return literal(value.encode())
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".").encode()
    if isinstance(value, int):
        return str(value).encode()
    if isinstance(value, list):
        return b"[" + b" ".join(map(written, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b" ".join(written(Name(k)) + b" " + written(v) for k, v in value.items()) + b">>"
    if isinstance(value, Stream):
        d = value.dictionary | {"Length": len(value.data)}
        return written(d) + b"\nstream\n" + value.data + b"\nendstream"
    raise TypeError(f"{type(value)} has no PDF form")


class Writer:
    """Objects, then a cross-reference table and a trailer. ``update`` adds a newer version of objects to a file."""

    def __init__(self, version: str = "1.4") -> None:
        self.version, self.objects = version, {}

    def add(self, value, n: int | None = None) -> Ref:
        n = n or len(self.objects) + 1
        self.objects[n] = value
        return Ref(n, 0)

    def bytes(self, root: Ref, info: Ref | None = None) -> bytes:
        return self._with(bytearray(f"%PDF-{self.version}\n".encode()), root, info, None, True)

    def update(self, base: bytes, root: Ref, prev: int, info: Ref | None = None) -> bytes:
        return self._with(bytearray(base), root, info, prev, False)

    def _with(self, out: bytearray, root: Ref, info: Ref | None, prev: int | None, whole: bool) -> bytes:
        places = {}
        for n, value in self.objects.items():
            places[n] = len(out)
            out += b"%d 0 obj\n" % n + written(value) + b"\nendobj\n"
        at = len(out)
        out += b"xref\n" + (b"0 1\n0000000000 65535 f \n" if whole else b"")
        for n in sorted(places):
            out += b"%d 1\n%010d 00000 n \n" % (n, places[n])
        trailer = {"Size": max(places, default=0) + 1, "Root": root} | ({"Info": info} if info else {}) | ({"Prev": prev} if prev is not None else {})
        out += b"trailer\n" + written(trailer) + b"\nstartxref\n%d\n%%%%EOF" % at
        return bytes(out)


def text_lines(text: str, size: float = 12.0, x: float = 72.0, top: float = 720.0, leading: float = 14.0) -> bytes:
    """A content stream that shows each line of text below the one before. Empty lines are shown as empty strings."""
    out = [b"BT", b"/F1 %s Tf" % written(size), b"%s TL" % written(leading), b"1 0 0 1 %s %s Tm" % (written(x), written(top))]
    for k, line in enumerate(text.split("\n")):
        out.append(literal(string_bytes(line)) + (b" '" if k else b" Tj"))
    return b"\n".join([*out, b"ET"])


def string_bytes(text: str) -> bytes:
    """Bytes that the heuristic decoding gives back as text."""
    return text.encode("utf-8", "replace")


def simple_pdf(pages: list[bytes], filters: list[str] | None = None, info: dict | None = None, box: list[float] | None = None, boxes: list[list[float]] | None = None, version: str = "1.4", font: dict | None = None) -> bytes:
    """A file with a page for each content stream (an empty one: a page without contents) and one font, F1."""
    w = Writer(version)
    catalog, tree = w.add({}), w.add({})
    f1 = w.add(font or {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")})
    kids = []
    for k, content in enumerate(pages):
        page = {"Type": Name("Page"), "Parent": tree, "Resources": {"Font": {"F1": f1}}}
        if boxes:
            page["MediaBox"] = list(boxes[k])
        if content:
            names: dict = {"Filter": [Name(f) for f in filters]} if filters else {}
            page["Contents"] = w.add(Stream(names, encode_filters(content, filters or [])))
        kids.append(w.add(page))
    w.objects[catalog.number] = {"Type": Name("Catalog"), "Pages": tree}
    w.objects[tree.number] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": list(box or [0, 0, 612, 792])}
    return w.bytes(catalog, w.add(info) if info else None)
