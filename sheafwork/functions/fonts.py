"""Character codes to text and widths: encodings, differences, ToUnicode maps, CID fonts."""

from __future__ import annotations

import string
from collections.abc import Iterator

from .lexer import Lexer
from .values import Name, Stream, number

DEFAULT_WIDTH = 500.0


def _table(codec: str) -> dict[int, str]:
    """All 256 codes of a codec; those it leaves undefined are the control characters of the same number."""
    return {i: bytes([i]).decode(codec, "ignore") or chr(i) for i in range(256)}


WIN_ANSI = _table("cp1252")
MAC_ROMAN = _table("mac_roman")
#: Glyph names of characters that aren't letters, and the ligatures, in the order of their codes.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&",
    "quoteright": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-",
    "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">",
    "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^",
    "underscore": "_", "quoteleft": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "bullet": "•", "emdash": "—", "endash": "–", "ellipsis": "…", "fi": "fi", "fl": "fl", "ffi": "ffi", "ffl": "ffl", "ff": "ff",
}
GLYPHS |= {c: c for c in string.ascii_letters}
ENCODINGS = {"WinAnsiEncoding": WIN_ANSI, "MacRomanEncoding": MAC_ROMAN}


def glyph_text(glyph: str) -> str | None:
    """The text of a glyph name, uniXXXX and uXXXXX names included; null if it isn't known."""
    known = GLYPHS.get(glyph)
    if known is None:
        for prefix, sizes in (("uni", (4,)), ("u", (4, 5, 6))):
            digits = glyph.removeprefix(prefix)
            if glyph.startswith(prefix) and len(digits) in sizes and all(c in "0123456789ABCDEF" for c in digits) and int(digits, 16) < 0x110000:
                return chr(int(digits, 16))
    return known


def utf16(data: bytes) -> str:
    """Text of a map's destination: UTF-16 with surrogates, else one character a byte."""
    if len(data) % 2 == 0:
        try:
            return data.decode("utf-16-be")
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


class CMap:
    """A ToUnicode map: (low, high) code ranges with their lengths, and text by code."""

    #: A range maps so many codes at most; longer ones are no two-byte codes.
    LONGEST = 1 << 16

    def __init__(self, data: bytes = b"") -> None:
        self.spaces: list[tuple[bytes, bytes]] = []
        self.text: dict[int, str] = {}
        operands: list = []
        for kind, value in self._operands(Lexer(data)):
            if kind != "word":
                operands.append(value)
                continue
            if value == "endcodespacerange":
                self.spaces += [(a, b) for a, b in zip(operands[::2], operands[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)]
            elif value == "endbfchar":
                self.text |= {int.from_bytes(a, "big"): utf16(b) for a, b in zip(operands[::2], operands[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif value == "endbfrange":
                for low, high, to in zip(operands[::3], operands[1::3], operands[2::3], strict=False):
                    if isinstance(low, bytes) and isinstance(high, bytes):
                        self._range(int.from_bytes(low, "big"), int.from_bytes(high, "big"), to)
            operands = []

    @staticmethod
    def _operands(lexer: Lexer) -> Iterator[tuple[str, object]]:
        array: list | None = None
        for t in lexer:
            if t.kind == "ARRAY_START":
                array = []
            elif t.kind == "ARRAY_END":
                yield "value", array or []
                array = None
            elif t.kind in ("HEX_STRING", "STRING", "INTEGER"):
                if array is not None:
                    array.append(t.value)
                else:
                    yield "value", t.value
            elif t.kind == "UNKNOWN" and array is None:
                yield "word", t.value

    def _range(self, low: int, high: int, to) -> None:
        for k in range(min(high - low + 1, self.LONGEST)):
            if isinstance(to, list):
                if k < len(to) and isinstance(to[k], bytes):
                    self.text[low + k] = utf16(to[k])
            elif isinstance(to, bytes) and to:
                value = int.from_bytes(to, "big") + k
                self.text[low + k] = utf16(value.to_bytes(max(len(to), (value.bit_length() + 7) // 8), "big"))

    def codes(self, data: bytes, default: int) -> Iterator[bytes]:
        """Cuts a string into codes by the code spaces; without them, into ``default`` bytes each."""
        at = 0
        while at < len(data):
            for low, high in self.spaces:
                n = len(low)
                part = data[at : at + n]
                if n and len(part) == n and len(high) == n and all(a <= p <= b for a, p, b in zip(low, part, high, strict=True)):
                    break
            else:
                part = data[at : at + default]
            yield part
            at += max(1, len(part))


def parse_encoding(value: dict) -> tuple[str, dict[int, str]]:
    """(base encoding, differences): numbers set the next code, names take it and go on."""
    code, out = 0, {}
    for v in value.get("Differences") or []:
        if isinstance(v, Name):
            out[code] = str(v)
            code += 1
        elif isinstance(v, int):
            code = v
    return str(value.get("BaseEncoding") or "WinAnsiEncoding"), out


class FontEncoder:
    """Text and widths of codes. Text comes from the first of: map, known difference, base encoding, Latin-1, U+FFFD."""

    def __init__(self, encoding: str = "WinAnsiEncoding", differences: dict[int, str] | None = None, to_unicode: dict[int, str] | None = None, widths: dict[int, float] | None = None, cmap: CMap | None = None, code_bytes: int = 1, default_width: float = DEFAULT_WIDTH) -> None:
        self.encoding, self.differences, self.widths = encoding, differences or {}, widths or {}
        self.cmap, self.to_unicode = cmap, to_unicode if to_unicode is not None else cmap.text if cmap else {}
        self.code_bytes, self.default_width = code_bytes, default_width

    def decode(self, code: int) -> str:
        known = self.to_unicode.get(code)
        if known is None and code in self.differences:
            known = glyph_text(self.differences[code])
        if known is None:
            known = ENCODINGS.get(self.encoding, {}).get(code)
        if known is None:
            known = chr(code) if 0 <= code < 256 else "�"
        return known

    def codes(self, data: bytes) -> list[int]:
        if self.code_bytes == 1 and not (self.cmap and self.cmap.spaces):
            return list(data)
        return [int.from_bytes(c, "big") for c in (self.cmap or CMap()).codes(data, self.code_bytes)]

    def decode_string(self, data: bytes) -> str:
        return "".join(map(self.decode, self.codes(data)))

    def width(self, code: int) -> float:
        return self.widths.get(code, self.default_width)


def simple_widths(font: dict, resolve) -> dict[int, float]:
    """Widths by code of a simple font: those of FirstChar and on; entries that aren't numbers are left out."""
    first, widths = resolve(font.get("FirstChar", 0)), resolve(font.get("Widths"))
    if not isinstance(widths, list) or not isinstance(first, int):
        return {}
    values = ((first + i, resolve(w)) for i, w in enumerate(widths))
    return {c: float(w) for c, w in values if isinstance(w, (int, float)) and not isinstance(w, bool)}


def cid_widths(array, resolve) -> dict[int, float]:
    """Widths by CID from a W array: first [w ...] or first last w."""
    out: dict[int, float] = {}
    values = [resolve(v) for v in array] if isinstance(array, list) else []
    at = 0
    while at + 1 < len(values):
        first, second = values[at], values[at + 1]
        if isinstance(second, list):
            out |= {int(number(first)) + k: number(resolve(w)) for k, w in enumerate(second)}
            at += 2
        elif at + 2 < len(values):
            for c in range(int(number(first)), min(int(number(second)), int(number(first)) + 65535) + 1):
                out[c] = number(values[at + 2])
            at += 3
        else:
            break
    return out


def encoder_of(font: dict, document) -> FontEncoder:
    """The encoder of a font dictionary."""
    resolve = document.resolve
    stream = resolve(font.get("ToUnicode"))
    cmap = CMap(document.decoded(stream)) if isinstance(stream, Stream) else None
    if resolve(font.get("Subtype")) == "Type0":
        below = resolve(font.get("DescendantFonts"))
        cid = resolve(below[0]) if isinstance(below, list) and below else None
        cid = cid if isinstance(cid, dict) else {}
        return FontEncoder("Identity", widths=cid_widths(resolve(cid.get("W")), resolve), cmap=cmap, code_bytes=2, default_width=number(resolve(cid.get("DW")), 1000.0))
    encoding = resolve(font.get("Encoding"))
    base, differences = (str(encoding), {}) if isinstance(encoding, Name) else ("WinAnsiEncoding", {})
    if isinstance(encoding, dict):
        base, differences = parse_encoding({k: resolve(v) for k, v in encoding.items()})
    return FontEncoder(base, differences, widths=simple_widths(font, resolve), cmap=cmap)


def page_encoders(document, page):
    """A page's encoders by font name; null for a name that it doesn't have."""
    fonts = document.fonts(page)
    return lambda name: encoder_of(fonts[name], document) if name in fonts else None
