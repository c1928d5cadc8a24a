"""Layout-aware text of HTML: a tree builder with implied tags, visibility rules, and a renderer.

The builder turns tags into a well-formed sequence of openings and closings: paragraphs, list items, cells, rows and
the like end where the next one's start implies it; end tags without a start are dropped, those of outer elements end
the inner ones. The renderer writes all visible text: blocks on lines of their own, paragraphs and headings apart by
an empty line, lists with marks and indents, preformatted text as it is, table cells in aligned columns (with
colspan and rowspan). Both work on an explicit stack, so depth is no limit. A cell of more than WIDE columns is no
measure for its table, and a row that would need more padding than PADDED times its text has its cells one below the
other: so time and memory are in proportion to the page. Not shown: what browsers never show (scripts, heads, the
fallback of object, audio, video and canvas), what styles or attributes hide, and closed details but their summary.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pages, small_batches

# Kinds of elements as the HTML standard has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist desc defs metadata annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav ol optgroup option section summary table tbody td tfoot th thead tr ul caption".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr xmp listing".split())
ENDS_P = BLOCK | APART
#: What an opening tag ends, and the elements that stop the search for it.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "head": (set(), set()),
    "body": ({"head"}, set()),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
#: Inline end tags don't reach over these.
SCOPE = frozenset("table td th caption html template".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())

TAG = re.compile(
    r"""<(?:!--(?P<comment>.*?)(?:-->|--!>|\Z)"""
    r"""|/(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"""
    r"""|(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|(?P<loose>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)(?:>|\Z)"""
    r"""|[!?/][^>]*+(?:>|\Z))""",
    re.S,
)
ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Columns of a cell beyond which it is no measure for others; padding of a row for each character of its text, and at least.
WIDE, PADDED, PADDED_LEAST = 60, 4, 1000
#: The largest numbers that the HTML standard takes.
MOST_SPAN, MOST_ROWS = 1000, 65534
BLANK = re.compile(r"[ \t\n\f\r]+")


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in ATTR.findall(text):
        out.setdefault(k.lower(), html.unescape(v[1:-1] if v[:1] in "\"'" and v[:1] else v))
    return out


def unseen(tag: str, attrs: dict[str, str]) -> bool:
    return tag in HIDDEN or "hidden" in attrs or tag == "input" or tag == "dialog" and "open" not in attrs or bool(UNSEEN.search(attrs.get("style", "")))


def tree(source: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("open", tag, attributes), ("close", tag, {}) and ("text", text, {}): balanced, in the order of the tree."""
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack
    at, n = 0, len(source)

    def pop() -> tuple[str, str, dict[str, str]]:
        tag = stack.pop()
        places[tag].pop()
        return "close", tag, {}

    def nearest(tags) -> int:
        return max([places[t][-1] for t in tags if places.get(t)], default=-1)

    def ended_by(tags, stops) -> int:
        """How many elements end with the outermost of tags above the nearest stop; 0 if there is none."""
        stop, found = nearest(stops), []
        for t in tags:
            at = places.get(t)
            if at and at[-1] > stop:
                found.append(at[bisect_right(at, stop)])
        return len(stack) - min(found) if found else 0

    while at < n:
        found = source.find("<", at)
        if found < 0:
            found = n
        match = TAG.match(source, found) if found < n else None
        if match is None and found < n:  # a lone "<" is text
            more = source.find("<", found + 1)
            found = n if more < 0 else more
            if source[at:found]:
                yield "text", source[at:found], {}
            at = found
            continue
        if source[at:found]:
            text = source[at:found]
            if stack and stack[-1] == "head" and not BLANK.fullmatch(text):
                yield pop()
            yield "text", text, {}
        if match is None:
            break
        at = match.end()
        tag = (match["start"] or match["loose"] or "").lower()
        if tag:
            attrs = attributes(match["attrs"] or match["rest"] or "")
            if stack and stack[-1] == "head" and tag not in HEAD_ONLY and tag != "head":
                yield pop()
            if tag in ("html", "body", "head") and places.get(tag):
                continue
            if tag in ENDS_P and places.get("p"):
                for _ in range(ended_by({"p"}, SCOPE | {"button", "object"})):
                    yield pop()
            if tag in IMPLIED:
                for _ in range(ended_by(*IMPLIED[tag])):
                    yield pop()
            yield "open", tag, attrs
            if tag in VOID:
                yield "close", tag, {}
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(source, at)
                raw = source[at : end.start() if end else n]
                if raw:
                    yield "text", raw, {}
                yield "close", tag, {}
                at = end.end() if end else n
                continue
            places.setdefault(tag, []).append(len(stack))
            stack.append(tag)
        elif match["end"]:
            tag = match["end"].lower()
            if tag == "br":
                yield "open", "br", {}
                yield "close", "br", {}
            elif tag == "p" and not places.get("p"):
                yield "open", "p", {}
                yield "close", "p", {}
            elif tag in ("html", "body"):
                pass  # what follows still belongs to them
            elif places.get(tag):
                stops = SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") else {"table"} - {tag}
                last = places[tag][-1]
                if last > nearest(stops):
                    for _ in range(len(stack) - last):
                        yield pop()
    while stack:
        yield pop()


def columns(text: str) -> int:
    """The columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines of text as they come; a table cell is a page of its own."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space, self.gap, self.indents, self.mark = False, False, [], ""

    def text(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.put(first)
            for part in rest:
                self.end(force=True)
                self.put(part)
            return
        words = BLANK.sub(" ", text)
        if not words:
            return
        if words[0] == " ":
            self.space, words = True, words[1:]
        if words:
            tail = words[-1] == " "
            self.put((" " if self.space and self.line else "") + (words[:-1] if tail else words))
            self.space = tail

    def put(self, text: str) -> None:
        if text:
            self.line.append(text)
            self.space = False

    def end(self, force: bool = False) -> None:
        """Ends the line, if it has text; with ``force`` an empty one too."""
        self.space = False
        if self.line or force or self.mark:
            if not (self.line or force):
                return
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            indent = "".join(self.indents)
            if self.mark:
                indent, self.mark = indent[: max(0, len(indent) - len(self.mark))] + self.mark, ""
            self.lines.append((indent + "".join(self.line)).rstrip() if self.line else "")
            self.line = []

    def apart(self) -> None:
        self.end()
        self.gap = bool(self.lines)

    def finish(self) -> list[str]:
        self.end()
        return self.lines


def span(attrs: dict[str, str], name: str, most: int) -> int:
    found = re.match(r"\s*(\d{1,9})", attrs.get(name, ""))
    return min(max(int(found[1]), 1), most) if found else 1


class Table:
    """Rows of (first column, columns, lines), with the columns that cells of earlier rows reach down into."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.column, self.open = 0, False
        self.down: list[tuple[int, int, int]] = []  # first column, past the last, past the last row

    def row(self) -> None:
        self.open = False

    def cell(self, lines: list[str], attrs: dict[str, str]) -> None:
        if not self.open:
            self.rows.append([])
            self.open, self.column = True, 0
            self.down = sorted(d for d in self.down if d[2] >= len(self.rows))
        n, rows = span(attrs, "colspan", MOST_SPAN), span(attrs, "rowspan", MOST_ROWS)
        for first, past, _ in self.down:
            if first <= self.column < past:
                self.column = past
            elif first > self.column:
                break
        self.rows[-1].append((self.column, n, lines))
        if rows > 1:
            self.down.append((self.column, self.column + n, len(self.rows) + rows - 1))
            self.down.sort()
        self.column += n

    def lines(self) -> list[str]:
        """The columns aligned, two spaces apart."""
        widths: dict[int, int] = {}
        for row in self.rows:
            for at, n, cell in row:
                width = max((w for w in map(columns, cell) if w <= WIDE), default=0)
                if n == 1 and width > widths.get(at, 0):
                    widths[at] = width
        starts, known = [0], sorted(widths)
        for c in known:
            starts.append(starts[-1] + widths[c])

        def start(column: int) -> int:
            """Where a column starts: the widths before it, and two spaces for each."""
            return starts[bisect_right(known, column - 1)] + 2 * column

        out = []
        for row in self.rows:
            height = max(len(cell) for _, _, cell in row)
            text = sum(map(len, (line for _, _, cell in row for line in cell)))
            padding = sum(start(max(at for at, _, cell in row if len(cell) > k)) for k in range(height)) if height * len(row) <= PADDED * text + PADDED_LEAST else None
            if padding is None or padding > PADDED * text + PADDED_LEAST:
                out += [line for _, _, cell in row for line in cell]
                continue
            for k in range(height):
                parts, width = [], 0
                for at, _, cell in row:
                    if len(cell) <= k:
                        continue
                    gap = max(start(at) - width, 2 if parts else 0)
                    parts += [" " * gap, cell[k]]
                    width += gap + columns(cell[k])
                out.append("".join(parts).rstrip())
        return out


def render(source: str) -> str:
    """All visible text of a page."""
    page, pages, tables, lists, closers = Page(), [], [], [], []
    cells: list[dict[str, str]] = []
    hidden = pre = 0
    seen = True  # by visibility, which inner elements may set again
    for kind, name, attrs in tree(source):
        if kind == "text":
            if not hidden and seen:
                page.text(html.unescape(name), pre > 0)
            continue
        if kind == "open":
            # A summary shows even where its details are closed.
            shown = name == "summary" and closers and closers[-1][0] == "details" and closers[-1][3]
            gone = unseen(name, attrs)
            closed = name == "details" and "open" not in attrs
            change = gone - shown
            was = seen
            if found := VISIBILITY.search(attrs.get("style", "")):
                seen = found[1].lower() == "visible"
            closers.append((name, change + closed, was, closed))
            hidden += change
            if hidden:
                hidden += closed
                continue
            if name == "br":
                page.end(force=True)
            elif name == "hr":
                page.apart()
            elif name in ("ul", "ol", "menu"):
                page.end() if lists else page.apart()
                start = attrs.get("start", "")
                lists.append([name == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                page.indents.append("  ")
            elif name == "li":
                page.end()
                if lists and lists[-1][0]:
                    page.mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                else:
                    page.mark = "- "
            elif name == "dd":
                page.end()
                page.indents.append("  ")
            elif name == "blockquote":
                page.apart()
                page.indents.append("  ")
            elif name == "table":
                page.apart()
                tables.append(Table())
                pages.append(page)
                page = Page()  # captions, and text between rows
            elif name == "tr":
                page.end()
                if tables:
                    tables[-1].row()
            elif name in ("td", "th") and tables:
                cells.append(attrs)
                pages.append(page)
                page = Page()
            elif name in APART:
                page.apart()
                pre += name in ("pre", "listing", "xmp")
            elif name in BLOCK:
                page.end()
            hidden += closed
            continue
        name, change, seen, closed = closers.pop()
        if closed and hidden == 1:  # details that are shown, but closed
            hidden, change = 0, 0
        if hidden:
            hidden -= change
            continue
        hidden -= change  # after a summary, its details are closed as before
        if name in ("ul", "ol", "menu"):
            page.end()
            page.mark = ""
            lists.pop()
            page.indents.pop()
            if not lists:
                page.apart()
        elif name in ("dd", "blockquote"):
            page.end()
            page.indents.pop()
            if name == "blockquote":
                page.apart()
        elif name == "li":
            page.end()
            page.mark = ""
        elif name in ("td", "th") and tables:
            cell, page = page.finish(), pages.pop()
            tables[-1].cell(cell, cells.pop())
        elif name == "table" and tables:
            around, page = page.finish(), pages.pop()
            body = around + tables.pop().lines()
            page.apart()
            for line in body:
                page.put(line)
                page.end(force=True)
            page.apart()
        elif name in APART:
            page.apart()
            pre -= name in ("pre", "listing", "xmp")
        elif name in BLOCK:
            page.end()
    return "\n".join(page.finish())


def extract_text(rows: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and text: the visible text of each row's page.

    A null or empty page has the empty text; a null id stays null; repeated rows come back each; an empty table gives
    no rows. Other columns are ignored.
    """
    small_batches(rows.sparkSession)
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(t or "") for t in part.column(1).to_pylist()], pa.string())], names=["_id", "text"])

    return rows.select(F.col(id_col).alias("_id"), F.col(html_col).cast("string").alias("_html")).mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)


def op9_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(pages(spark, sf_dir))
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op9_html_layout": op9_html_layout}
SQL: dict[str, str] = {}
