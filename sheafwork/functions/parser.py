"""Objects from tokens. Comments are skipped; malformed parts give what can be read of them."""

from __future__ import annotations

import re

from .lexer import Lexer, Token
from .values import Name, ParseError, Ref, Stream

_LINE_END = re.compile(rb"\r\n|\n|\r")
_END_STREAM = re.compile(rb"(?:\r\n|\n|\r)?endstream\b")
#: Deeper nesting is no document but an attack on the stack.
DEPTH = 200


class ObjectParser:
    """Reads values at a place in a file. ``resolve`` gives what a reference stands for (for a stream's Length)."""

    def __init__(self, data: bytes, at: int = 0, resolve=None) -> None:
        self.lexer, self.back, self.resolve = Lexer(data, at), [], resolve

    def token(self) -> Token | None:
        if self.back:
            return self.back.pop()
        while (t := self.lexer.next()) is not None and t.kind == "COMMENT":
            pass
        return t

    def value(self, depth: int = 0):
        t = self.token()
        if t is None:
            raise ParseError("the data end where a value is expected")
        return self.value_of(t, depth)

    def value_of(self, t: Token, depth: int):
        if depth > DEPTH:
            raise ParseError(f"values are nested deeper than {DEPTH}")
        kind = t.kind
        if kind == "INTEGER":
            second = self.token()
            if second is not None and second.kind == "INTEGER":
                third = self.token()
                if third is not None and third.kind == "INDIRECT_REF":
                    return Ref(t.value, second.value)
                if third is not None:
                    self.back.append(third)
            if second is not None:
                self.back.append(second)
            return t.value
        if kind in ("REAL", "NAME", "STRING", "HEX_STRING", "BOOLEAN", "NULL"):
            return t.value
        if kind == "ARRAY_START":
            out = []
            while (t := self.token()) is not None and t.kind != "ARRAY_END":
                if t.kind in ("OBJ_END", "ENDOFFILE"):
                    self.back.append(t)
                    break
                if t.kind not in ("UNKNOWN", "DICT_END"):
                    out.append(self.value_of(t, depth + 1))
            return out
        if kind == "DICT_START":
            return self.dictionary(depth)
        if kind == "OBJ_END":
            self.back.append(t)
            return None
        raise ParseError(f"{t.kind} {t.value!r} at {t.offset} where a value is expected")

    def dictionary(self, depth: int) -> dict:
        out: dict = {}
        while (t := self.token()) is not None and t.kind != "DICT_END":
            if t.kind in ("OBJ_END", "ENDOFFILE"):
                self.back.append(t)
                break
            if t.kind == "NAME":
                key, t = t.value, self.token()
                if t is None or t.kind == "DICT_END":
                    break
                out[key] = None if t.kind == "UNKNOWN" else self.value_of(t, depth + 1)
        return out

    def indirect(self) -> tuple[int, int, object]:
        """number, generation and value of ``n g obj ...`` here."""
        n, g, o = self.token(), self.token(), self.token()
        if not (n and g and o) or (n.kind, g.kind, o.kind) != ("INTEGER", "INTEGER", "OBJ_START"):
            raise ParseError("no object begins here")
        value = self.value()
        if isinstance(value, dict):
            t = self.token()
            if t is not None and t.kind == "STREAM_START":
                value = self.stream(value, t.offset + len("stream"))
        return n.value, g.value, value

    def stream(self, dictionary: dict, at: int) -> Stream:
        data = self.lexer.data
        line_end = _LINE_END.match(data, at)
        start = line_end.end() if line_end else at
        length = dictionary.get("Length")
        if isinstance(length, Ref) and self.resolve:
            length = self.resolve(length)
        if isinstance(length, int) and length >= 0 and start + length <= len(data) and _END_STREAM.match(data, start + length):
            return Stream(dictionary, data[start : start + length], start)
        found = _END_STREAM.search(data, start)
        if found is None and isinstance(length, int) and 0 <= length <= len(data) - start:
            return Stream(dictionary, data[start : start + length], start)
        return Stream(dictionary, data[start : found.start() if found else len(data)], start)


def names_only(value) -> list[Name]:
    return [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, Name)]
