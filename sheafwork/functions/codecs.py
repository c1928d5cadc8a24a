"""Stream filters: decoding, and encoding for round trips."""

from __future__ import annotations

import re
import zlib

from .values import Name, ParseError

#: Abbreviations that inline images use.
SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "RL": "RunLengthDecode"}
_BLANKS = b" \t\r\n\0\f\v"
_HEX_PAIR = re.compile(rb"[0-9A-Fa-f]{2}\Z")


def flate_decode(data: bytes) -> bytes:
    """zlib data, else raw deflate data, else the data unchanged; of a stream cut short, what there is."""
    for wbits in (15, -15):
        inflate = zlib.decompressobj(wbits)
        try:
            return inflate.decompress(data) + inflate.flush()
        except zlib.error:
            continue
    inflate, out = zlib.decompressobj(15), bytearray()
    try:
        for at in range(0, len(data), 64):
            out += inflate.decompress(data[at : at + 64])
    except zlib.error:
        pass
    return bytes(out) or data


def flate_encode(data: bytes) -> bytes:
    return zlib.compress(data)


def lzw_decode(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears the table, 257 ends. A code out of the table ends too."""
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    out, held, bits, width, last = [], 0, 0, 9, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code == 257:
            break
        if code < len(table) and code < 4096:
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            break
        out.append(entry)
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        while width < 12 and len(table) + early >= 1 << width:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes, early: int = 1) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    codes = {bytes([i]): i for i in range(256)}
    free = 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer] = free
        free += 1
        # The reader's table is one entry behind: it learns an entry with the code after it.
        if free - 1 + early >= 1 << width and width < 12:
            width += 1
        if free >= 4095:
            put(256)
            codes, free, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(codes[word])
        free += 1
        if free - 1 + early >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def ascii85_decode(data: bytes) -> bytes:
    """Groups of five digits; z is four zeros, ~ ends, <~ may begin, blanks don't count. Other characters are an error."""
    data = data.translate(None, _BLANKS)
    if data.startswith(b"<~"):
        data = data[2:]
    data = data.partition(b"~")[0]
    out, group = bytearray(), []
    for c in data:
        if c == 0x7A:
            if group:
                raise ParseError("z inside a group of ASCII85 digits")
            out += bytes(4)
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += _of_base85(group)
                group = []
        else:
            raise ParseError(f"{c} is no ASCII85 digit")
    if len(group) > 1:
        out += _of_base85(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _of_base85(digits: list[int]) -> bytes:
    n = 0
    for d in digits:
        n = n * 85 + d
    return (n & 0xFFFFFFFF).to_bytes(4, "big")


def ascii85_encode(data: bytes) -> bytes:
    out = bytearray()
    for at in range(0, len(data), 4):
        part = data[at : at + 4]
        n = int.from_bytes(part.ljust(4, b"\0"), "big")
        if not n and len(part) == 4:
            out += b"z"
            continue
        digits = []
        for _ in range(5):
            n, d = divmod(n, 85)
            digits.append(d + 0x21)
        out += bytes(digits[::-1][: len(part) + 1])
    return bytes(out) + b"~>"


def asciihex_decode(data: bytes) -> bytes:
    """Pairs of digits up to >; a pair that isn't hexadecimal is dropped, an odd last digit is followed by 0."""
    digits = data.partition(b">")[0].translate(None, _BLANKS)
    if len(digits) % 2:
        digits += b"0"
    pairs = (digits[i : i + 2] for i in range(0, len(digits), 2))
    return b"".join(bytes.fromhex(p.decode()) for p in pairs if _HEX_PAIR.match(p))


def asciihex_encode(data: bytes) -> bytes:
    return data.hex().upper().encode() + b">"


def runlength_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n == 128:
            break
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def runlength_encode(data: bytes) -> bytes:
    out = bytearray()
    for run in re.finditer(rb"(?s)(.)\1{1,127}|(?:(.)(?!\2)){1,128}", data):
        part = run[0]
        out += bytes([257 - len(part)]) + part[:1] if run[1] is not None else bytes([len(part) - 1]) + part
    return bytes(out) + b"\x80"


def unpredicted(data: bytes, parms: dict) -> bytes:
    """Undoes a predictor: 2 is TIFF's (of eight-bit components), 10 and more are PNG's."""
    predictor = parms.get("Predictor", 1)
    if not isinstance(predictor, int) or predictor < 2:
        return data
    colors, depth, columns = (parms.get(k, d) if isinstance(parms.get(k, d), int) else d for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    pixel, row = max(1, colors * depth // 8), (colors * depth * columns + 7) // 8
    if predictor == 2:
        if depth != 8:
            return data
        out = bytearray(data)
        for at in range(0, len(out), row):
            for i in range(at + pixel, min(at + row, len(out))):
                out[i] = (out[i] + out[i - pixel]) & 255
        return bytes(out)
    out, above = bytearray(), bytearray(row)
    for at in range(0, len(data), row + 1):
        kind, line = data[at], bytearray(data[at + 1 : at + 1 + row])
        for i in range(len(line)):
            left = line[i - pixel] if i >= pixel else 0
            up = above[i]
            if kind == 1:
                guess = left
            elif kind == 2:
                guess = up
            elif kind == 3:
                guess = (left + up) // 2
            elif kind == 4:
                corner = above[i - pixel] if i >= pixel else 0
                p = left + up - corner
                guess = min((left, up, corner), key=lambda v: abs(p - v))
            else:
                guess = 0
            line[i] = (line[i] + guess) & 255
        out += line
        above = line.ljust(row, b"\0")
    return bytes(out)


DECODERS = {
    "FlateDecode": lambda d, p: unpredicted(flate_decode(d), p),
    "LZWDecode": lambda d, p: unpredicted(lzw_decode(d, p.get("EarlyChange", 1) if isinstance(p.get("EarlyChange", 1), int) else 1), p),
    "ASCII85Decode": lambda d, p: ascii85_decode(d),
    "ASCIIHexDecode": lambda d, p: asciihex_decode(d),
    "RunLengthDecode": lambda d, p: runlength_decode(d),
}
ENCODERS = {"FlateDecode": flate_encode, "LZWDecode": lzw_encode, "ASCII85Decode": ascii85_encode, "ASCIIHexDecode": asciihex_encode, "RunLengthDecode": runlength_encode}


def register_filter(name: str, decode) -> None:
    """Adds decode(data, parameters) under a filter's name, in this process and those that import the caller's module."""
    DECODERS[name] = decode


def decode_filters(data: bytes, filters, parms=None, extra: dict | None = None) -> bytes:
    """Applies a stream's filters in order. A filter that isn't known leaves the data as they are."""
    names = filters if isinstance(filters, list) else [filters] if filters is not None else []
    given = parms if isinstance(parms, list) else [parms]
    for k, f in enumerate(names):
        f = SHORT.get(str(f), str(f))
        p = given[k] if k < len(given) and isinstance(given[k], dict) else {}
        decode = (extra or {}).get(f) or DECODERS.get(f)
        if decode:
            data = decode(data, p)
    return data


def encode_filters(data: bytes, filters: list[str]) -> bytes:
    """What decode_filters with the same list turns back into data."""
    for f in reversed(filters):
        data = ENCODERS[f](data)
    return data


def filter_names(filters) -> list[Name]:
    return [Name(SHORT.get(str(f), str(f))) for f in (filters if isinstance(filters, list) else [filters]) if f is not None]
