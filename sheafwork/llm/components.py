"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import cut, drop_shared, hot_safe_lookup, write_shared


def _kept(nodes: DataFrame, most: int) -> DataFrame:
    """A table of nodes from a checkpoint, unless it is small enough to be broadcast at once."""
    return nodes if most <= common.BROADCAST_ROWS else cut(nodes)


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """Each node's larger neighbours link to the smallest of the node and its neighbours. Edges go from larger to smaller.

    A node without smaller neighbours, as the middle of a large component is, changes nothing for its own.
    """
    least = edges.groupBy(F.col("_a").alias("_b")).agg(F.min("_b").alias("_m"))
    nodes = _kept(edges.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).join(least, "_b", "left"), most)
    met = hot_safe_lookup(edges, nodes, ["_b"], "_n", F.xxhash64("_a"), most)
    return met.select("_a", F.coalesce("_m", "_b").alias("_b")).distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """Each node and its smaller neighbours link to the smallest of these."""
    nodes = _kept(edges.groupBy("_a").agg(F.min("_b").alias("_m"), F.count(F.lit(1)).alias("_n")), most)
    met = hot_safe_lookup(edges, nodes, ["_a"], "_n", F.xxhash64("_b"), most)
    moved = met.filter("_b <> _m").select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
    return moved.unionByName(nodes.select("_a", F.col("_m").alias("_b"))).distinct()


def component_labels(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(_node, _root): for each node of links (_a, _b), the smallest node of its component.

    Rounds go on until one changes nothing; each doubles what a node knows, so their number follows the logarithm of
    the longest path. Each is a checkpoint. No table of links is ever gathered, and the links of a node with many are
    dealt out over tasks.
    """
    edges, path = write_shared(links.filter("_a <> _b").select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct(), "links")
    state = None
    for _ in range(rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        edges, new = write_shared(_small_star(cut(_large_star(edges, now[0])), now[0]), "links")  # no more links than before
        drop_shared(links.sparkSession, path)
        path = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    edges = cut(edges)
    drop_shared(links.sparkSession, path)
    roots = edges.select(F.col("_a").alias("_node"), F.col("_b").alias("_root"))
    return roots.unionByName(roots.select(F.col("_root").alias("_node"), "_root").distinct())
