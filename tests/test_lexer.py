import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sheafwork.functions.lexer import KINDS, Lexer, tokenize
from sheafwork.functions.values import Name

RNG = random.Random(32000)
REGULAR = [c for c in range(33, 127) if c not in b"()<>[]{}/%#"]


def only(data):
    (token,) = tokenize(data)
    assert token.kind in KINDS and token.offset == 0
    return token.kind, token.value


def test_numbers_at_random():
    """Digits with a sign and a point in every place, against Python's reading of them."""
    for _ in range(300):
        digits = "".join(RNG.choice("0123456789") for _ in range(RNG.randint(1, 7)))
        sign, at = RNG.choice(["", "+", "-"]), RNG.randint(0, len(digits))
        assert only((sign + digits).encode()) == ("INTEGER", int(sign + digits))
        real = sign + digits[:at] + "." + digits[at:]
        assert only(real.encode()) == ("REAL", float(real))


def test_names_at_random():
    """Regular characters stand for themselves; any byte but 0 may come as # and two digits in either case."""
    for _ in range(200):
        text, source = "", b"/"
        for _ in range(RNG.randint(0, 12)):
            c = RNG.choice(REGULAR)
            escaped = RNG.random() < 0.3
            source += (b"#%02x" if RNG.random() < 0.5 else b"#%02X") % c if escaped else bytes([c])
            text += chr(c)
        assert only(source) == ("NAME", text)
    assert only(b"/q#2") == ("NAME", "q#2") and only(b"/x#g0") == ("NAME", "x#g0")


ESCAPES = {b"\\n": b"\n", b"\\r": b"\r", b"\\t": b"\t", b"\\b": b"\b", b"\\f": b"\f", b"\\(": b"(", b"\\)": b")", b"\\\\": b"\\", b"\\\n": b"", b"\\\r\n": b"", b"\\053": b"+", b"\\5z": b"\x05z", b"\\z": b"z"}


def test_literal_strings_at_random():
    """Parts of a string: plain bytes, escapes of ISO 32000's table, and balanced brackets."""
    for _ in range(300):
        source, value = b"", b""
        for _ in range(RNG.randint(0, 8)):
            kind = RNG.randrange(3)
            if kind == 0:
                part = bytes(RNG.choice(REGULAR) for _ in range(RNG.randint(1, 4)))
                source, value = source + b" " + part.replace(b"\\", b"/"), value + b" " + part.replace(b"\\", b"/")
            elif kind == 1:
                k = RNG.choice(list(ESCAPES))
                source, value = source + k, value + ESCAPES[k]
            else:
                source, value = b"(" + source + b")", b"(" + value + b")"
        assert only(b"(" + source + b")") == ("STRING", value)
    assert only(b"(no end") == ("STRING", b"no end")


def test_hex_strings_at_random():
    """Digits in either case with white space anywhere; an odd last digit has a zero after it."""
    for _ in range(200):
        digits = "".join(RNG.choice("0123456789abcdefABCDEF") for _ in range(RNG.randint(0, 9)))
        source = "".join(d + RNG.choice(["", "", " ", "\r\n", "\t"]) for d in digits)
        assert only(b"<" + source.encode() + b">") == ("HEX_STRING", bytes.fromhex(digits + "0" * (len(digits) % 2)))


@pytest.mark.parametrize(("word", "kind", "value"), [("true", "BOOLEAN", True), ("false", "BOOLEAN", False), ("null", "NULL", None), ("R", "INDIRECT_REF", "R"), *((w, k, w) for w, k in {"obj": "OBJ_START", "endobj": "OBJ_END", "stream": "STREAM_START", "endstream": "STREAM_END", "xref": "XREF", "trailer": "TRAILER", "startxref": "STARTXREF"}.items())])
def test_keywords(word, kind, value):
    assert only(word.encode()) == (kind, value)
    assert only(word.encode() + b"q") == ("UNKNOWN", word + "q")  # only as whole words


@pytest.mark.parametrize("word", ["7-", "8.0.", "+", "-.", "ET", "T*"])
def test_other_words(word):
    assert only(word.encode()) == ("UNKNOWN", word)


def test_comments():
    assert only(b"%EOF\r") == ("COMMENT", "%EOF") and only(b"%%EOF") == ("ENDOFFILE", "%%EOF")
    assert [t.kind for t in tokenize(b"7%c(\n8")] == ["INTEGER", "COMMENT", "INTEGER"]


def test_sequences():
    """Tokens need no space between them where a delimiter parts them; white space alone gives none."""
    assert list(tokenize(b"\x00\t\n\x0c\r ")) == []
    parts = [(b"[", "ARRAY_START"), (b"]", "ARRAY_END"), (b"<<", "DICT_START"), (b">>", "DICT_END"), (b"(s)", "STRING"), (b"<0f>", "HEX_STRING"), (b"/n ", "NAME"), (b"12 ", "INTEGER")]
    for _ in range(100):
        chosen = [RNG.choice(parts) for _ in range(RNG.randint(0, 12))]
        if any(a[1] in ("DICT_START", "HEX_STRING") or b[1] in ("DICT_END",) for a, b in zip(chosen, chosen[1:], strict=False)):
            source = b" ".join(p for p, _ in chosen)
        else:
            source = b"".join(p for p, _ in chosen)
        assert [t.kind for t in tokenize(source)] == [k for _, k in chosen]


def test_offsets_and_seek():
    lexer = Lexer(b" 5\n/Kids<</K 0>>")
    assert [t.offset for t in lexer] == [1, 3, 8, 10, 13, 14]
    lexer.seek(3)
    assert lexer.next().value == Name("Kids") and lexer.tell() == 8


@given(st.binary(max_size=200))
def test_any_bytes_end(data):
    offsets = [t.offset for t in tokenize(data)]
    assert offsets == sorted(set(offsets))


@given(st.binary(max_size=100))
def test_literal_round_trip(data):
    from sheafwork.functions.writer import literal

    (token,) = tokenize(literal(data))
    assert token.value == data
