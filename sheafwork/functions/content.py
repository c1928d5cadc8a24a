"""Content streams: operators, and the text elements that the text operators show."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from .fonts import DEFAULT_WIDTH, FontEncoder
from .geometry import IDENTITY, Matrix
from .lexer import Lexer, Token

_INLINE_END = re.compile(rb"[ \t\r\n\0\f]EI(?=[ \t\r\n\0\f]|\Z)")
#: Widths of codes, in thousandths, where a font has none: spaces, capitals, all others.
SPACE_WIDTH, CAPITAL_WIDTH = 250.0, 700.0
DEPTH = 100


class Operator(NamedTuple):
    name: str
    operands: list
    offset: int


def _array(lexer: Lexer, depth: int) -> list:
    out: list = []
    while (t := lexer.next()) is not None and t.kind != "ARRAY_END":
        if t.kind == "ARRAY_START":
            out.append(_array(lexer, depth + 1) if depth < DEPTH else [])
        elif t.kind == "DICT_START":
            _skip_dictionary(lexer)
        elif t.kind in ("INTEGER", "REAL", "NAME", "STRING", "HEX_STRING", "BOOLEAN", "NULL"):
            out.append(t.value)
    return out


def _skip_dictionary(lexer: Lexer) -> None:
    depth = 1
    while depth and (t := lexer.next()) is not None:
        depth += (t.kind == "DICT_START") - (t.kind == "DICT_END")


def operators(data: bytes) -> Iterator[Operator]:
    """Operators with the operands before them. Dictionaries are no operands; image data are passed over."""
    lexer, operands = Lexer(data), []
    while (t := lexer.next()) is not None:
        if t.kind in ("INTEGER", "REAL", "NAME", "STRING", "HEX_STRING", "BOOLEAN", "NULL"):
            operands.append(t.value)
        elif t.kind == "ARRAY_START":
            operands.append(_array(lexer, 0))
        elif t.kind == "DICT_START":
            _skip_dictionary(lexer)
        elif is_word(t):
            yield Operator(t.value, operands, t.offset)
            operands = []
            if t.value == "ID":
                end = _INLINE_END.search(data, lexer.at)
                lexer.at = end.end() if end else len(data)
                yield Operator("EI", [], lexer.at - 2)


def is_word(t: Token) -> bool:
    """Keywords of files are operators here like any other word; lone brackets and malformed numbers are not."""
    if t.kind == "UNKNOWN":
        return t.value[:1] not in "()<>[]{}0123456789+-."
    return t.kind not in ("COMMENT", "ENDOFFILE", "ARRAY_END", "DICT_END") and isinstance(t.value, str)


class Element(NamedTuple):
    """A shown string: what it says, where, how wide, and the state it was shown in."""

    text: str
    x: float
    y: float
    width: float
    height: float
    font_name: str | None
    font_size: float
    char_spacing: float
    word_spacing: float
    horizontal_scaling: float
    text_render_mode: int
    raw_bytes: bytes

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        return self.x, self.y, self.x + self.width, self.y + self.height


@dataclass(slots=True)
class TextState:
    font_name: str | None = None
    font_size: float = 0.0
    char_spacing: float = 0.0
    word_spacing: float = 0.0
    scaling: float = 100.0
    leading: float = 0.0
    render_mode: int = 0
    rise: float = 0.0


@dataclass(slots=True)
class Paint:
    """Colours, line style and clip, as extensions may set them: extraction of text has no use for them."""

    stroke_color: tuple[float, ...] = (0.0,)
    fill_color: tuple[float, ...] = (0.0,)
    line_width: float = 1.0
    line_cap: int = 0
    line_join: int = 0
    miter_limit: float = 10.0
    dash: tuple[tuple[float, ...], float] = ((), 0.0)
    clip: object = None


@dataclass(slots=True)
class State:
    """What q saves: the transformation, the text state, the text position, and what paints."""

    ctm: Matrix = IDENTITY
    text: TextState = field(default_factory=TextState)
    tm: Matrix = IDENTITY
    line: Matrix = IDENTITY
    paint: Paint = field(default_factory=Paint)

    def copy(self) -> State:
        return State(self.ctm, replace(self.text), self.tm, self.line, replace(self.paint))

    def render_position(self, spec: bool = False) -> tuple[float, float]:
        """Where the next text is shown: with ``spec`` as ISO 32000 says, raised by the rise; else as in extraction."""
        return (self.tm * self.ctm).point(0, self.text.rise) if spec else (self.ctm * self.tm).point(0, 0)

    def baseline_position(self, spec: bool = False) -> tuple[float, float]:
        """The same without the rise."""
        return (self.tm * self.ctm).point(0, 0) if spec else self.render_position()

    def offset_line(self, y: float) -> None:
        """To the start of the line that is ``y`` above the current one."""
        self.tm = self.line = Matrix.translation(self.line.e, self.line.f + y)


def heuristic_text(raw: bytes) -> str:
    """UTF-16 if it begins with its mark (which stays), else UTF-8, else Latin-1."""
    if raw[:2] == b"\xfe\xff":
        try:
            return raw.decode("utf-16-be")
        except UnicodeDecodeError:
            pass
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def default_width(code: int) -> float:
    return SPACE_WIDTH if code == 32 else CAPITAL_WIDTH if 65 <= code <= 90 else DEFAULT_WIDTH


class Interpreter:
    """Runs a page's operators.

    geometry "compatible": the text position is moved in user space as it is, transformations apply in the order
    CTM, Tm, and widths and heights ignore Tm. geometry "spec": as ISO 32000 says. decoding "heuristic" goes by the
    bytes of each string, "font" by the font's encoding. ``extra`` maps operators to functions (interpreter, operands).
    """

    def __init__(self, encoder_of: Callable[[str], FontEncoder | None] | None = None, geometry: str = "compatible", decoding: str = "heuristic", extra: dict[str, Callable] | None = None) -> None:
        if geometry not in ("compatible", "spec") or decoding not in ("heuristic", "font"):
            raise ValueError(f"unknown geometry {geometry!r} or decoding {decoding!r}")
        self.encoder_of, self.spec, self.by_font = encoder_of or (lambda name: None), geometry == "spec", decoding == "font"
        self.state, self.saved, self.elements = State(), [], []
        self.table = {k: getattr(self, "op_" + v) for k, v in OPERATORS.items()} | {k: (lambda args, f=f: f(self, args)) for k, f in (extra or {}).items()}
        self.encoders: dict[str | None, FontEncoder | None] = {}

    def run(self, data: bytes) -> list[Element]:
        table = self.table
        for name, operands, _ in operators(data):
            action = table.get(name)
            if action:
                try:
                    action(operands)
                except (TypeError, ValueError, IndexError):  # operands of other kinds: the operator has no effect
                    continue
        return self.elements

    # Graphics state

    def op_save(self, args) -> None:
        self.saved.append(self.state.copy())

    def op_restore(self, args) -> None:
        if self.saved:
            self.state = self.saved.pop()

    def op_concat(self, args) -> None:
        if len(args) == 6:
            self.state.ctm = Matrix.of(args) * self.state.ctm

    # Text state

    def op_begin(self, args) -> None:
        self.state.tm = self.state.line = IDENTITY

    def op_end(self, args) -> None:
        """Text outside BT and ET is shown all the same, so this changes nothing."""

    def op_font(self, args) -> None:
        name, size = args[0], float(args[1])
        self.state.text.font_name, self.state.text.font_size = str(name), size

    def op_char_spacing(self, args) -> None:
        self.state.text.char_spacing = float(args[0])

    def op_word_spacing(self, args) -> None:
        self.state.text.word_spacing = float(args[0])

    def op_scaling(self, args) -> None:
        self.state.text.scaling = float(args[0])

    def op_leading(self, args) -> None:
        self.state.text.leading = float(args[0])

    def op_render_mode(self, args) -> None:
        self.state.text.render_mode = int(args[0])

    def op_rise(self, args) -> None:
        self.state.text.rise = float(args[0])

    # Text position

    def op_move(self, args) -> None:
        x, y = float(args[0]), float(args[1])
        if self.spec:
            self.state.line = self.state.tm = Matrix.translation(x, y) * self.state.line
        else:
            self.state.tm = self.state.tm.moved(x, y)

    def op_move_leading(self, args) -> None:
        y = float(args[1])
        self.state.text.leading = -y
        self.op_move(args)

    def op_next_line(self, args) -> None:
        s = self.state
        if self.spec:
            s.line = s.tm = Matrix.translation(0, -s.text.leading) * s.line
        else:
            s.offset_line(-s.text.leading)

    def op_matrix(self, args) -> None:
        if len(args) == 6:
            self.state.tm = self.state.line = Matrix.of(args)

    # Showing text

    def op_show(self, args) -> None:
        if args and isinstance(args[0], (bytes, str)):
            self.show(args[0])

    def op_line_show(self, args) -> None:
        self.op_next_line(args)
        self.op_show(args)

    def op_spaced_show(self, args) -> None:
        if len(args) >= 3:
            self.op_word_spacing(args[:1])
            self.op_char_spacing(args[1:2])
            self.op_next_line(args)
            self.op_show(args[2:3])

    def op_array_show(self, args) -> None:
        for item in args[0] if args and isinstance(args[0], list) else ():
            if isinstance(item, (bytes, str)):
                self.show(item)
            elif isinstance(item, (int, float)) and not isinstance(item, bool):
                t = self.state.text
                self.advance(-float(item) / 1000.0 * t.font_size * (t.scaling / 100.0))

    def encoder(self) -> FontEncoder | None:
        name = self.state.text.font_name
        if name not in self.encoders:
            self.encoders[name] = self.encoder_of(name) if name is not None else None
        return self.encoders[name]

    def width_of(self, raw: bytes) -> float:
        t, font = self.state.text, self.encoder()
        scaling, total = t.scaling / 100.0, 0.0
        known = font.widths if font else {}
        codes = font.codes(raw) if font and (self.spec or self.by_font) else raw
        for c in codes:
            w = known.get(c, font.default_width if font and font.code_bytes > 1 else DEFAULT_WIDTH) if known else default_width(c)
            w = w / 1000.0 * t.font_size
            total += w * scaling if self.spec else w
            total += t.char_spacing * scaling
            if c == 32:
                total += t.word_spacing * scaling
        return total

    def advance(self, x: float) -> None:
        s = self.state
        s.tm = Matrix.translation(x, 0) * s.tm if self.spec else s.tm.moved(x, 0)

    def show(self, raw: bytes | str) -> None:
        raw = raw.encode("latin-1", "replace") if isinstance(raw, str) else raw
        s, t = self.state, self.state.text
        width = self.width_of(raw)
        if self.spec:
            to_user = s.tm * s.ctm
            x, y = s.render_position(True)
            dx, dy = to_user.vector(width, 0)
            hx, hy = to_user.vector(0, t.font_size)
            shown, height = (dx**2 + dy**2) ** 0.5, (hx**2 + hy**2) ** 0.5
        else:
            x, y = s.render_position()
            shown, height = s.ctm.vector(width, 0)[0], t.font_size
        font = self.encoder() if self.by_font else None
        text = font.decode_string(raw) if font else heuristic_text(raw)
        self.elements.append(Element(text, x, y, shown, height, t.font_name, t.font_size, t.char_spacing, t.word_spacing, t.scaling, t.render_mode, raw))
        self.advance(width)


#: The operators that have an effect, and their methods.
OPERATORS = {
    "q": "save", "Q": "restore", "cm": "concat", "BT": "begin", "ET": "end", "Tf": "font", "Tc": "char_spacing", "Tw": "word_spacing",
    "Tz": "scaling", "TL": "leading", "Tr": "render_mode", "Ts": "rise", "Td": "move", "TD": "move_leading", "T*": "next_line",
    "Tm": "matrix", "Tj": "show", "'": "line_show", '"': "spaced_show", "TJ": "array_show",
}


def page_elements(data: bytes, encoder_of=None, **how) -> list[Element]:
    return Interpreter(encoder_of, **how).run(data)
