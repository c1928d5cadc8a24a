"""Values that PDF objects hold, and their tagged JSON form for VARIANT columns.

Scalars, lists and dictionaries are Python's own; strings are bytes. Names, references and streams have types.
"""

from __future__ import annotations

import base64
import json
from typing import NamedTuple


class ParseError(Exception):
    """A file, or a part of it, that can't be read as PDF."""


class Name(str):
    """A name without its slash; equal to the string of the same text."""

    __slots__ = ()

    def __repr__(self) -> str:
        return f"/{self}"


class Ref(NamedTuple):
    """A reference to an indirect object."""

    number: int
    generation: int


class Stream:
    """A stream's dictionary and its bytes as they stand in the file."""

    __slots__ = ("dictionary", "data", "offset")

    def __init__(self, dictionary: dict, data: bytes, offset: int = 0) -> None:
        self.dictionary, self.data, self.offset = dictionary, data, offset

    def get(self, key: str, default=None):
        return self.dictionary.get(key, default)

    def __repr__(self) -> str:
        return f"Stream({self.dictionary!r}, {len(self.data)} bytes)"


#: Names that PDF readers look for, by their usual constants.
NAMES = {
    n: Name(n)
    for n in (
        "Type Page Pages Catalog Parent Kids Count MediaBox Contents Resources Font Length Filter FlateDecode LZWDecode "
        "ASCIIHexDecode ASCII85Decode RunLengthDecode Subtype XObject Form Image Width Height ColorSpace BitsPerComponent "
        "Encoding ToUnicode BaseFont FirstChar LastChar DescendantFonts CIDFontType0 CIDFontType2"
    ).split()
}
#: 64-bit signed integers are what a BIGINT holds.
INT_MAX = (1 << 63) - 1


def kind_of(value) -> str:
    """The kind of an object, as the column ``kind`` has it."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "real"
    if isinstance(value, Name):
        return "name"
    if isinstance(value, (bytes, bytearray)):
        return "string"
    if isinstance(value, Ref):
        return "reference"
    if isinstance(value, Stream):
        return "stream"
    return "array" if isinstance(value, list) else "dictionary"


def tagged(value):
    """A value for JSON: {"n": name}, {"ref": [number, generation]}, {"b": base64}, {"dict": ..., "stream": bytes}."""
    if isinstance(value, Name):
        return {"n": str(value)}
    if isinstance(value, Ref):
        return {"ref": [value.number, value.generation]}
    if isinstance(value, (bytes, bytearray)):
        return {"b": base64.b64encode(value).decode()}
    if isinstance(value, Stream):
        return {"dict": tagged(value.dictionary), "stream": len(value.data)}
    if isinstance(value, list):
        return [tagged(v) for v in value]
    if isinstance(value, dict):
        return {str(k): tagged(v) for k, v in value.items()}
    if isinstance(value, int) and not isinstance(value, bool) and abs(value) > INT_MAX:
        return None
    return value


def to_json(value) -> str:
    return json.dumps(tagged(value), ensure_ascii=False, separators=(",", ":"))


def number(value, default: float = 0.0) -> float:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else default
