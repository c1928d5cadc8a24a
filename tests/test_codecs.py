import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sheafwork.functions import codecs
from sheafwork.functions.values import ParseError


@pytest.mark.parametrize("name", sorted(codecs.ENCODERS))
@given(data=st.one_of(st.binary(max_size=600), st.text("ab", max_size=3000).map(str.encode)))
def test_round_trip(name, data):
    assert codecs.decode_filters(codecs.encode_filters(data, [name]), name) == data


@pytest.mark.parametrize("early", [0, 1])
@pytest.mark.parametrize("data", [b"abc" * 60000, bytes(range(256)) * 300, b""])
def test_lzw_full_tables(early, data):
    assert codecs.lzw_decode(codecs.lzw_encode(data, early), early) == data


def test_lzw_known_codes():
    # The example of the format's specification.
    assert codecs.lzw_decode(bytes.fromhex("800B6050220C0C8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_flate_forms():
    raw = zlib.compressobj(wbits=-15)
    assert codecs.flate_decode(raw.compress(b"x" * 99) + raw.flush()) == b"x" * 99
    assert codecs.flate_decode(b"not deflated") == b"not deflated"
    assert codecs.flate_decode(zlib.compress(bytes(range(256)) * 99)[:-60])[:256] == bytes(range(256))


def test_ascii85_forms():
    assert codecs.ascii85_decode(b"<~87cUR\nD]~>") == b"Hello"
    assert codecs.ascii85_decode(b"z~>") == bytes(4)
    with pytest.raises(ParseError):
        codecs.ascii85_decode(b"ABz")


def test_asciihex_forms():
    assert codecs.asciihex_decode(b"48 65 6C6c 6F7>zz") == b"Hellop"
    assert codecs.asciihex_decode(b"48zz49>") == b"HI"


@pytest.mark.parametrize("kind", range(5))
def test_png_predictors(kind):
    rows, width = [bytes((r * 7 + c * c) & 255 for c in range(9)) for r in range(5)], 3
    out, above = bytearray(), bytes(9)
    for row in rows:
        out.append(kind)
        for i, v in enumerate(row):
            left, up, corner = row[i - width] if i >= width else 0, above[i], above[i - width] if i >= width else 0
            p = left + up - corner
            guess = [0, left, up, (left + up) // 2, min((left, up, corner), key=lambda x: abs(p - x))][kind]
            out.append((v - guess) & 255)
        above = row
    parms = {"Predictor": 15, "Colors": 3, "Columns": 3}
    assert codecs.decode_filters(zlib.compress(bytes(out)), ["FlateDecode"], [parms]) == b"".join(rows)


def test_unknown_filter_and_short_names():
    assert codecs.decode_filters(b"abc", ["Mystery"]) == b"abc"
    assert codecs.decode_filters(b"4849>", "AHx") == b"HI"
    assert codecs.decode_filters(b"abc", ["Twice"], extra={"Twice": lambda d, p: d + d}) == b"abcabc"
