"""Tokens of PDF syntax, by compiled patterns over the bytes. The same lexer reads files and content streams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from .values import Name

SPACE = b" \t\r\n\0\f"
#: Kinds of tokens, by the names that the column ``type`` has.
KINDS = (
    "INTEGER REAL STRING HEX_STRING NAME BOOLEAN NULL ARRAY_START ARRAY_END DICT_START DICT_END STREAM_START STREAM_END "
    "OBJ_START OBJ_END XREF TRAILER STARTXREF ENDOFFILE INDIRECT_REF COMMENT UNKNOWN"
).split()
KEYWORDS = {
    b"true": ("BOOLEAN", True),
    b"false": ("BOOLEAN", False),
    b"null": ("NULL", None),
    b"obj": ("OBJ_START", "obj"),
    b"endobj": ("OBJ_END", "endobj"),
    b"stream": ("STREAM_START", "stream"),
    b"endstream": ("STREAM_END", "endstream"),
    b"xref": ("XREF", "xref"),
    b"trailer": ("TRAILER", "trailer"),
    b"startxref": ("STARTXREF", "startxref"),
    b"R": ("INDIRECT_REF", "R"),
}
_BLANK = re.compile(rb"[ \t\r\n\0\f]*+")
_TOKEN = re.compile(
    rb"(?P<comment>%[^\r\n]*+(?:\r\n|\r|\n)?)"
    rb"|/(?P<name>[^ \t\r\n\0\f()<>\[\]{}/%]*+)"
    rb"|(?P<number>[0-9+-][0-9+.-]*+)"
    rb"|(?P<pair><<|>>)"
    rb"|<(?P<hex>[^>]*+)>?"
    rb"|(?P<string>\()"
    rb"|(?P<word>[^ \t\r\n\0\f()<>\[\]{}/%]++)"
    rb"|(?P<single>.)",
    re.S,
)
_PAREN = re.compile(rb"[()\\]")
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|\r|\n)|(.)|\Z)", re.S)
_EOL = re.compile(rb"\r\n?")
_NAME_HEX = re.compile(rb"#([0-9A-Fa-f]{2})")
_NOT_HEX = re.compile(rb"[^0-9A-Fa-f]")
_INT = re.compile(rb"[+-]?\d+\Z")
_REAL = re.compile(rb"[+-]?(?:\d+\.\d*|\d*\.\d+)\Z")
_LETTERS = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Token(NamedTuple):
    kind: str
    value: object
    offset: int


def _unescaped(match: re.Match) -> bytes:
    octal, line_end, char = match.groups()
    if octal:
        return bytes([int(octal, 8) & 255])
    if line_end:
        return b""
    if char is None:
        return b""
    # 8 and 9 begin no octal code: the backslash stays.
    return _LETTERS.get(char) or (b"\\" + char if char in b"89" else char)


def literal_string(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose opening parenthesis ends before ``at``, and where it ends; the end of data ends it too."""
    start, depth, n = at, 1, len(data)
    while True:
        found = _PAREN.search(data, at)
        if not found:
            stop, at = n, n
            break
        char, at = found[0], found.end()
        if char == b"\\":
            at = min(at + 1, n)
        elif char == b"(":
            depth += 1
        else:
            depth -= 1
            if not depth:
                stop = at - 1
                break
    raw = data[start:stop]
    if b"\\" in raw:
        raw = _ESCAPE.sub(_unescaped, raw)
    return raw, at


def hex_string(raw: bytes) -> bytes:
    """The bytes of a hex string's inside; what isn't hexadecimal is kept as it stands."""
    digits = raw.translate(None, SPACE)
    if _NOT_HEX.search(digits):
        return digits
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def name(raw: bytes) -> Name:
    if b"#" in raw:
        raw = _NAME_HEX.sub(lambda m: bytes.fromhex(m[1].decode()), raw)
    return Name(raw.decode("utf-8", "replace"))


def numeral(raw: bytes) -> int | float | None:
    if _INT.match(raw):
        return int(raw)
    return float(raw) if _REAL.match(raw) else None


class Lexer:
    """Tokens from ``at`` on; every call moves forward, whatever the bytes are."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def tell(self) -> int:
        return self.at

    def seek(self, at: int) -> None:
        self.at = at

    def next(self) -> Token | None:
        data = self.data
        at = _BLANK.match(data, self.at).end()
        found = _TOKEN.match(data, at)
        if not found:
            self.at = len(data)
            return None
        self.at = found.end()
        kind, raw = found.lastgroup, found[found.lastgroup]
        if kind == "number":
            value = numeral(raw)
            if value is None:
                return Token("UNKNOWN", raw.decode("latin-1"), at)
            return Token("INTEGER" if isinstance(value, int) else "REAL", value, at)
        if kind == "name":
            return Token("NAME", name(raw), at)
        if kind == "word":
            if raw in KEYWORDS:
                return Token(*KEYWORDS[raw], at)
            value = numeral(raw)
            return Token("UNKNOWN", raw.decode("latin-1"), at) if value is None else Token("REAL", float(value), at)
        if kind == "string":
            value, self.at = literal_string(data, self.at)
            return Token("STRING", value, at)
        if kind == "hex":
            return Token("HEX_STRING", hex_string(raw), at)
        if kind == "pair":
            return Token("DICT_START" if raw == b"<<" else "DICT_END", raw.decode(), at)
        if kind == "comment":
            text = raw.rstrip(b"\r\n").decode("latin-1")
            return Token("ENDOFFILE" if text.startswith("%%EOF") else "COMMENT", text, at)
        kinds = {b"[": "ARRAY_START", b"]": "ARRAY_END"}
        return Token(kinds.get(raw, "UNKNOWN"), raw.decode("latin-1"), at)

    def __iter__(self) -> Iterator[Token]:
        while (token := self.next()) is not None:
            yield token


def tokenize(data: bytes) -> Iterator[Token]:
    return iter(Lexer(data))
