"""Elements to lines to blocks, in native expressions over a page's array of elements.

A page is one array: it is sorted once, folded once into slices (a line is a run of the sorted elements), and each
slice becomes a line. Work per page is a sort and a pass; nothing is shuffled when pages come as arrays, and flat
element tables need one exchange by (doc_id, page_number).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("tolerance", "cluster")


@dataclass(frozen=True)
class GroupingConfig:
    """y_tolerance parts lines, space_width parts words, line_gap_threshold parts blocks; x_tolerance has no effect."""

    y_tolerance: float = 5.0
    x_tolerance: float = 5.0
    space_width: float = 3.0
    line_gap_threshold: float = 1.5
    grouping_mode: str = "cluster"

    def __post_init__(self) -> None:
        object.__setattr__(self, "grouping_mode", str(self.grouping_mode).lower())
        if self.grouping_mode not in MODES:
            raise ValueError(f"grouping_mode is one of {', '.join(MODES)}, not {self.grouping_mode!r}")
        if self.grouping_mode == "tolerance" and self.y_tolerance == 0:
            raise ZeroDivisionError("tolerance lines need a y_tolerance other than 0")

    def column(self) -> Column:
        return F.struct(*(F.lit(float(v) if k != "grouping_mode" else v).alias(k) for k, v in self.__dict__.items()))


def sorted_elements(elements: Column, config: GroupingConfig) -> Column:
    """Structs (a, b, seq, key, e): cluster lines go by (-y, x, seq), tolerance lines by key from the top, then seq."""
    tol = F.lit(float(config.y_tolerance))
    if config.grouping_mode == "cluster":
        return F.array_sort(F.transform(elements, lambda e: F.struct((-e["y"]).alias("a"), e["x"].alias("b"), e["seq"].alias("seq"), e["y"].alias("key"), e.alias("e"))))
    key = lambda e: F.rint(e["y"] / tol) * tol  # half to even
    return F.array_sort(F.transform(elements, lambda e: F.struct((-key(e)).alias("a"), F.lit(0.0).alias("b"), e["seq"].alias("seq"), key(e).alias("key"), e.alias("e"))))


def line_slices(ordered: Column, config: GroupingConfig) -> Column:
    """(y, n) of each line from the top: how many of the sorted elements it takes.

    As y never rises, an element can only join the last line: an earlier one was left because it was too far above,
    and what follows is no higher.
    """
    tol = F.lit(float(config.y_tolerance))
    cluster = config.grouping_mode == "cluster"
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.expr("CAST(array() AS ARRAY<STRUCT<y: DOUBLE, n: INT>>)").alias("done"))

    def y_of(acc: Column) -> Column:
        return acc["sum"] / F.greatest(acc["n"], F.lit(1)) if cluster else acc["sum"]

    def closed(acc: Column) -> Column:
        return F.when(acc["n"] > 0, F.array_append(acc["done"], F.struct(y_of(acc).alias("y"), acc["n"].alias("n")))).otherwise(acc["done"])

    def step(acc: Column, s: Column) -> Column:
        same = (acc["n"] > 0) & ((F.abs(s["key"] - y_of(acc)) <= tol) if cluster else (s["key"] == acc["sum"]))
        more = acc["sum"] + s["key"] if cluster else acc["sum"]
        return F.struct(F.when(same, more).otherwise(s["key"]).alias("sum"), F.when(same, acc["n"] + 1).otherwise(1).alias("n"), F.when(same, acc["done"]).otherwise(closed(acc)).alias("done"))

    return F.aggregate(ordered, start, step, closed)


def with_starts(slices: Column) -> Column:
    """The same with the place (from 1) where each begins."""
    kind = "ARRAY<STRUCT<y: DOUBLE, n: INT, first: INT>>"
    start = F.struct(F.lit(1).alias("at"), F.expr(f"CAST(array() AS {kind})").alias("out"))
    step = lambda acc, s: F.struct((acc["at"] + s["n"]).alias("at"), F.array_append(acc["out"], F.struct(s["y"].alias("y"), s["n"].alias("n"), acc["at"].alias("first"))).alias("out"))
    return F.aggregate(slices, start, step, lambda acc: acc["out"])


def line_of(parts: Column, y: Column, config: GroupingConfig) -> Column:
    """A line from its elements in order of (x, order before): one space where the gap is wider than space_width."""
    gap = F.lit(float(config.space_width))
    end = lambda e: e["x"] + e["width"]
    piece = lambda p, i: F.concat(F.when((i > 0) & (p["e"]["x"] - end(F.get(parts, i - 1)["e"]) > gap), " ").otherwise(""), p["e"]["text"])
    fragments = F.transform(parts, lambda p: F.struct(*(p["e"][c].alias(c) for c in ("text", "x", "y", "width", "height"))))
    return F.struct(
        F.array_join(F.transform(parts, piece), "").alias("text"),
        y.alias("y"),
        F.array_min(F.transform(parts, lambda p: p["e"]["x"])).alias("x_start"),
        F.array_max(F.transform(parts, lambda p: end(p["e"]))).alias("x_end"),
        F.size(parts).alias("fragment_count"),
        fragments.alias("fragments"),
    )


def lines_of(elements: str, config: GroupingConfig, df: DataFrame) -> DataFrame:
    """df with ``lines``, an array of lines from the top, from its array column ``elements``."""
    out = df.withColumn("_sorted", sorted_elements(F.col(elements), config))
    out = out.withColumn("_slices", with_starts(line_slices(F.col("_sorted"), config)))
    by_x = lambda s: F.array_sort(F.transform(F.slice("_sorted", s["first"], s["n"]), lambda p: F.struct(p["e"]["x"].alias("x"), p["a"].alias("a"), p["seq"].alias("seq"), p["e"].alias("e"))))
    out = out.withColumn("_parts", F.transform("_slices", lambda s: F.struct(s["y"].alias("y"), by_x(s).alias("parts"))))
    return out.withColumn("lines", F.transform("_parts", lambda s: line_of(s["parts"], s["y"], config))).drop("_sorted", "_slices", "_parts")


def block_sizes(lines: Column, config: GroupingConfig) -> Column:
    """How many lines each block takes. The mean gap moves by a tenth with each gap, that under test included."""
    threshold = F.lit(float(config.line_gap_threshold))
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("y"), none.alias("mean"), F.lit(0).alias("n"), F.expr("CAST(array() AS ARRAY<INT>)").alias("done"))

    def step(acc: Column, line: Column) -> Column:
        gap = acc["y"] - line["y"]
        mean = F.when(acc["y"].isNull(), none).when(acc["mean"].isNull(), gap).otherwise(F.lit(0.9) * acc["mean"] + F.lit(0.1) * gap)
        cut = F.coalesce(gap > mean * threshold, F.lit(False))
        done = F.when(cut, F.array_append(acc["done"], acc["n"])).otherwise(acc["done"])
        return F.struct(line["y"].alias("y"), mean.alias("mean"), F.when(cut, 1).otherwise(acc["n"] + 1).alias("n"), done.alias("done"))

    return F.aggregate(lines, start, step, lambda acc: F.when(acc["n"] > 0, F.array_append(acc["done"], acc["n"])).otherwise(acc["done"]))


def blocks_of(df: DataFrame, config: GroupingConfig, geometry: str = "compatible") -> DataFrame:
    """df with ``blocks`` from its ``lines``. In compatible geometry a bound of 0 counts as not yet set."""
    slices = with_starts(F.transform(block_sizes(F.col("lines"), config), lambda n: F.struct(F.lit(0.0).alias("y"), n.alias("n"))))
    out = df.withColumn("_blocks", F.transform(slices, lambda s: F.slice("lines", s["first"], s["n"])))

    def bound(lines: Column, name: str, pick) -> Column:
        if geometry == "spec":
            return (F.array_min if pick is F.least else F.array_max)(F.transform(lines, lambda n: n[name]))
        return F.aggregate(lines, F.lit(0.0), lambda a, n: F.when(a == 0, n[name]).otherwise(pick(a, n[name])))

    def block(lines: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(lines, lambda n: n["text"]), "\n").alias("text"),
            F.size(lines).alias("line_count"),
            bound(lines, "x_start", F.least).alias("x_start"),
            bound(lines, "x_end", F.greatest).alias("x_end"),
            F.element_at(lines, 1)["y"].alias("y_start"),
            F.element_at(lines, -1)["y"].alias("y_end"),
            lines.alias("lines"),
        )

    return out.withColumn("blocks", F.transform("_blocks", block)).drop("_blocks")


def collected(elements: DataFrame) -> DataFrame:
    """One row a page with the array ``elements`` of a flat table: the one exchange."""
    rest = [c for c in elements.columns if c not in ("doc_id", "page_number")]
    return elements.groupBy("doc_id", "page_number").agg(F.collect_list(F.struct(*rest)).alias("elements"))


def group_lines(elements: DataFrame, config: GroupingConfig | None = None) -> DataFrame:
    """doc_id, page_number, line_no (from 1) and the line, of a flat table of elements."""
    pages = lines_of("elements", config or GroupingConfig(), collected(elements))
    return pages.select("doc_id", "page_number", F.posexplode("lines").alias("_n", "_l")).select("doc_id", "page_number", (F.col("_n") + 1).alias("line_no"), "_l.*")


def group_blocks(elements: DataFrame, config: GroupingConfig | None = None, geometry: str = "compatible") -> DataFrame:
    """doc_id, page_number, block_no (from 1) and the block, of a flat table of elements."""
    config = config or GroupingConfig()
    pages = blocks_of(lines_of("elements", config, collected(elements)), config, geometry)
    return pages.select("doc_id", "page_number", F.posexplode("blocks").alias("_n", "_b")).select("doc_id", "page_number", (F.col("_n") + 1).alias("block_no"), "_b.*")


def plain_text(elements: DataFrame, config: GroupingConfig | None = None, line_separator: str = "\n", block_separator: str = "\n\n") -> DataFrame:
    """doc_id, page_number, text: lines and blocks joined."""
    config = config or GroupingConfig()
    pages = blocks_of(lines_of("elements", config, collected(elements)), config)
    text = F.array_join(F.transform("blocks", lambda b: F.array_join(F.transform(b["lines"], lambda n: n["text"]), line_separator)), block_separator)
    return pages.select("doc_id", "page_number", text.alias("text"))
