"""One PDF file: header, cross-references, objects, page tree, page contents, metadata. Objects are read when asked for."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

from .codecs import decode_filters
from .parser import ObjectParser
from .values import Name, ParseError, Ref, Stream, number

DEFAULT_BOX = [0.0, 0.0, 612.0, 792.0]
#: Bytes at the end of a file among which the last startxref is sought.
TAIL = 1024
_STARTXREF = re.compile(rb"startxref[ \t\r\n\0\f]*(\d*)")
_SUBSECTION = re.compile(rb"[ \t\r\n\0\f]*(\d+)[ \t]+(\d+)[ \t]*(?:\r\n|\r|\n)?")
_ENTRY = re.compile(rb"[ \t\r\n\0\f]*(\d{1,10})[ \t]+(\d{1,5})[ \t]+([nf])(?=[ \t\r\n\0\f]|\Z|\D)")
_LINE = re.compile(rb"[ \t\r\n\0\f]*[^\r\n]*")
_TRAILER = re.compile(rb"[ \t\r\n\0\f]*trailer")


class Entry(NamedTuple):
    """Where an object is: kind 0 free, 1 at an offset, 2 in an object stream."""

    number: int
    offset: int
    generation: int
    free: bool
    kind: int
    stream_number: int | None = None
    index: int | None = None


class Section(NamedTuple):
    entries: dict[int, Entry]
    trailer: dict


class Page(NamedTuple):
    number: int
    ref: Ref | None
    dictionary: dict
    media_box: list[float]
    resources: dict


def header_version(data: bytes) -> str:
    if data[:5] != b"%PDF-":
        raise ParseError("the file doesn't begin with %PDF-")
    return data[5:8].decode("ascii", "replace")


def startxref(data: bytes) -> int:
    """The number after the last startxref in the file's tail."""
    at = data.rfind(b"startxref", max(0, len(data) - TAIL))
    found = _STARTXREF.match(data, at) if at >= 0 else None
    if not found or not found[1]:
        raise ValueError("no startxref with an offset near the end of the file")
    return int(found[1])


class Document:
    """A file's bytes and what is read of them. Broken cross-references raise; broken objects are null."""

    def __init__(self, data: bytes, filters: dict | None = None) -> None:
        self.data, self.filters = bytes(data), filters
        self.objects: dict[tuple[int, int], object] = {}
        self.opened: set[int] = set()
        self.object_streams: dict[int, dict[int, object]] = {}

    @cached_property
    def version(self) -> str:
        return header_version(self.data)

    # Cross-references

    @cached_property
    def sections(self) -> list[Section]:
        """From the newest on, by the chain of Prev; each place once."""
        out, seen, todo = [], set(), [startxref(self.data)]
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                if not out:
                    raise ParseError(f"startxref points outside the file: {at}")
                continue
            seen.add(at)
            section = self.section(at)
            out.append(section)
            todo = [v for k in ("XRefStm", "Prev") if isinstance(v := section.trailer.get(k), int)] + todo
        return out

    def section(self, at: int) -> Section:
        start = len(self.data) - len(self.data[at:].lstrip(b" \t\r\n\0\f"))
        if self.data.startswith(b"xref", start):
            return self.table(start + 4)
        if self.data[start : start + 1].isdigit():
            return self.xref_stream(start)
        found = self.data.find(b"trailer", start)
        if found < 0:
            raise ParseError(f"no cross-references at {at}")
        return Section({}, self.trailer_at(found + 7))

    def table(self, at: int) -> Section:
        entries: dict[int, Entry] = {}
        while not (end := _TRAILER.match(self.data, at)):
            head = _SUBSECTION.match(self.data, at)
            if not head:
                raise ParseError(f"no trailer after the cross-references before {at}")
            first, count, at = int(head[1]), int(head[2]), head.end()
            for n in range(first, first + count):
                entry = _ENTRY.match(self.data, at)
                if entry:
                    free = entry[3] == b"f"
                    entries[n] = Entry(n, int(entry[1]), int(entry[2]), free, 0 if free else 1)
                    at = entry.end()
                elif _TRAILER.match(self.data, at) or at >= len(self.data):
                    break
                else:
                    at = _LINE.match(self.data, at).end()
        return Section(entries, self.trailer_at(end.end()))

    def trailer_at(self, at: int) -> dict:
        value = ObjectParser(self.data, at).value()
        if not isinstance(value, dict):
            raise ValueError("a trailer without a dictionary")
        return {k: v for k, v in value.items() if v is not None}

    def xref_stream(self, at: int) -> Section:
        _, _, stream = ObjectParser(self.data, at).indirect()
        if not isinstance(stream, Stream):
            raise ParseError(f"no cross-reference stream at {at}")
        d = stream.dictionary
        widths = [w for w in d.get("W", []) if isinstance(w, int)]
        if len(widths) != 3:
            raise ParseError("a cross-reference stream without three widths")
        data, row = self.decoded(stream), sum(widths)
        index = d.get("Index") or [0, d.get("Size", 0)]
        entries, place = {}, 0
        for first, count in zip(index[::2], index[1::2], strict=False):
            for n in range(first, first + count):
                part = data[place : place + row]
                if len(part) < row or not row:
                    break
                place += row
                a, b = widths[0], widths[0] + widths[1]
                kind = int.from_bytes(part[:a], "big") if a else 1
                x, y = int.from_bytes(part[a:b], "big"), int.from_bytes(part[b:], "big")
                if kind == 0:
                    entries[n] = Entry(n, x, y, True, 0)
                elif kind == 1:
                    entries[n] = Entry(n, x, y, False, 1)
                elif kind == 2:
                    entries[n] = Entry(n, 0, 0, False, 2, x, y)
        hidden = ("Type", "W", "Index", "Length", "Filter", "DecodeParms")
        return Section(entries, {k: v for k, v in d.items() if k not in hidden and v is not None})

    @cached_property
    def entries(self) -> dict[int, Entry]:
        """The newest entry of each object."""
        out: dict[int, Entry] = {}
        for section in self.sections:
            for n, entry in section.entries.items():
                out.setdefault(n, entry)
        return out

    @cached_property
    def trailer(self) -> dict:
        """The newest trailer, and keys that only older ones have."""
        out: dict = {}
        for section in self.sections:
            for k, v in section.trailer.items():
                out.setdefault(k, v)
        return out

    def offset_of(self, n: int) -> int | None:
        entry = self.entries.get(n)
        return None if entry is None or entry.free or entry.kind == 2 else entry.offset

    # Objects

    def object(self, n: int, generation: int = 0):
        """The object's value; null if there is none, it is free, or another stands at its place."""
        key = (n, generation)
        if key not in self.objects:
            entry = self.entries.get(n)
            self.objects[key] = None  # what it would find of itself meanwhile
            if entry is not None and not entry.free:
                self.objects[key] = self.compressed(entry) if entry.kind == 2 else self.at(entry, generation)
        return self.objects[key]

    def at(self, entry: Entry, generation: int):
        if not entry.offset or entry.generation != generation:
            return None
        try:
            n, g, value = ObjectParser(self.data, entry.offset, self.resolve).indirect()
        except ParseError:
            return None
        return value if (n, g) == (entry.number, generation) else None

    def compressed(self, entry: Entry):
        inside = self.object_streams.get(entry.stream_number)
        if inside is None:
            inside = self.object_streams[entry.stream_number] = {}
            stream = self.object(entry.stream_number)
            if isinstance(stream, Stream):
                data = self.decoded(stream)
                first, count = self.resolve(stream.get("First")), self.resolve(stream.get("N"))
                head = ObjectParser(data[:first])
                for _ in range(count if isinstance(count, int) else 0):
                    n, at = head.token(), head.token()
                    if n is None or at is None:
                        break
                    try:
                        inside[n.value] = ObjectParser(data, first + at.value).value()
                    except (ParseError, TypeError):
                        inside[n.value] = None
        return inside.get(entry.number)

    def resolve(self, value):
        """What a value stands for, through references of references."""
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.object(*value)
        return None

    def all_objects(self) -> Iterator[tuple[Entry, object]]:
        for n in sorted(self.entries):
            entry = self.entries[n]
            if not entry.free:
                yield entry, self.object(n, entry.generation)

    def decoded(self, stream: Stream) -> bytes:
        filters = self.resolve(stream.get("Filter", stream.get("F")))
        parms = self.resolve(stream.get("DecodeParms", stream.get("DP")))
        if isinstance(filters, list):
            filters = [self.resolve(f) for f in filters]
        if isinstance(parms, list):
            parms = [self.resolve(p) for p in parms]
        flat = lambda p: {k: self.resolve(v) for k, v in p.items()} if isinstance(p, dict) else p
        return decode_filters(stream.data, filters, [flat(p) for p in parms] if isinstance(parms, list) else flat(parms), self.filters)

    # Pages

    @cached_property
    def catalog(self) -> dict:
        root = self.trailer.get("Root")
        if not isinstance(root, Ref):
            raise ParseError("no reference to a root in the trailer")
        catalog = self.object(*root)
        if not isinstance(catalog, dict):
            raise ParseError("the root object can't be read")
        return catalog

    @cached_property
    def pages(self) -> list[Page]:
        """Leaves of the page tree in order; boxes and resources come from ancestors where a page has none."""
        top = self.catalog.get("Pages")
        if not isinstance(self.resolve(top), dict):
            raise ParseError("the root has no page tree")
        out: list[Page] = []
        todo = [(top, {}, frozenset())]
        while todo:
            node, given, above = todo.pop()
            value = self.resolve(node)
            if not isinstance(value, dict) or isinstance(node, Ref) and node in above:
                continue
            given = given | {k: value[k] for k in ("MediaBox", "Resources") if value.get(k) is not None}
            kind = self.resolve(value.get("Type"))
            if kind == "Page":
                resources = self.resolve(given.get("Resources"))
                out.append(Page(len(out) + 1, node if isinstance(node, Ref) else None, value, self.box(given.get("MediaBox")), resources if isinstance(resources, dict) else {}))
            elif kind == "Pages":
                kids = self.resolve(value.get("Kids"))
                below = above | {node} if isinstance(node, Ref) else above
                todo += [(k, given, below) for k in reversed(kids if isinstance(kids, list) else [])]
        return out

    def box(self, value) -> list[float]:
        value = self.resolve(value)
        if not isinstance(value, list) or len(value) < 4:
            return list(DEFAULT_BOX)
        return [number(self.resolve(v)) for v in value[:4]]

    def contents(self, page: Page) -> bytes | None:
        """A page's decoded content; parts of an array are parted by a line end. Null if the page has none."""
        value = self.resolve(page.dictionary.get("Contents"))
        if isinstance(value, Stream):
            return self.decoded(value)
        if not isinstance(value, list):
            return None
        out = bytearray()
        for part in value:
            part = self.resolve(part)
            if isinstance(part, Stream) and (data := self.decoded(part)):
                out += data
                if out[-1:] != b"\n":
                    out += b"\n"
        return bytes(out)

    def fonts(self, page: Page) -> dict[str, dict]:
        """The page's font dictionaries by their names in its resources."""
        fonts = self.resolve(page.resources.get("Font"))
        found = {k: self.resolve(v) for k, v in fonts.items()} if isinstance(fonts, dict) else {}
        return {k: v for k, v in found.items() if isinstance(v, dict)}

    @cached_property
    def metadata(self) -> dict[str, str]:
        info = self.resolve(self.trailer.get("Info"))
        return {k: metadata_text(self.resolve(v)) for k, v in info.items()} if isinstance(info, dict) else {}


def opened(data: bytes, filters: dict | None = None) -> Document:
    """A document whose header was checked."""
    document = Document(data, filters)
    header_version(document.data)
    return document


def metadata_text(value) -> str:
    if isinstance(value, bytes):
        if value[:2] == b"\xfe\xff":
            return value[2:].decode("utf-16-be", "replace")
        try:
            return value.decode("utf-8")
        except UnicodeDecodeError:
            return value.decode("latin-1")
    return str(value)


def names(value) -> list[str]:
    return [str(v) for v in (value if isinstance(value, list) else [value]) if isinstance(v, Name)]
