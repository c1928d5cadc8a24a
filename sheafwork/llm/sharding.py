"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring is 2**CELL_BITS equal cells. Each shard has ``vnodes`` virtual nodes, each in a cell of its own; a cell
belongs to the first virtual node at or after it, clockwise. A key falls into the cell of its hash. A shard takes the
keys of its own cells first; what exceeds its capacity continues clockwise to the next virtual node whose shard still
has room. The fill is settled on the table of counts a cell, whose size is a parameter (2**CELL_BITS rows), never on
rows. With slack 0 the capacities are the two whole numbers around the mean, so counts are at most one apart.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, documents

CELL_BITS = 13
SEGMENTS = T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("cell", "first", "past", "shard", "base")]))


def ring(n_shards: int, vnodes: int, seed: int, cell_bits: int = CELL_BITS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order. A taken cell sends the later node one cell on."""
    size, taken = 1 << cell_bits, {}
    if n_shards * vnodes > size:
        raise ValueError(f"{n_shards} shards of {vnodes} virtual nodes need more than {size} cells")
    for shard in range(n_shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.sha256(f"{seed}:{shard}:{v}".encode()).digest()[:8]) >> (64 - cell_bits)
            while at in taken:
                at = (at + 1) % size
            taken[at] = shard
    return sorted(taken.items())


def capacities(total: int, n_shards: int, slack: float) -> list[int]:
    if slack:
        return [-(-int(total * (1 + slack)) // n_shards) + 1] * n_shards
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def fill(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int], cell_bits: int = CELL_BITS) -> list[tuple[int, int, int, int]]:
    """(cell, first rank, rank past the last, shard): which of a cell's keys, by rank, each shard takes."""
    room, at, node_of = list(room), 0, []
    for cell in range(1 << cell_bits):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        node_of.append(at % len(nodes))
    out, left = [], [(cell, node_of[cell], 0, n) for cell, n in sorted(counts.items()) if n]
    while left:
        later = []
        for cell, node, first, n in left:
            shard = nodes[node][1]
            took = min(n - first, room[shard])
            if took:
                room[shard] -= took
                out.append((cell, first, first + took, shard))
            if first + took < n:
                later.append((cell, (node + 1) % len(nodes), first + took, n))
        left = later
    return sorted(out)


def assign_shards(rows: DataFrame, key: str, n_shards: int, vnodes: int = 64, slack: float = 0.0, seed: int = 7, tie: str | None = None) -> DataFrame:
    """rows with shard (0 to n_shards - 1) and slot (0, 1, ... within the shard).

    A null key is placed by the column ``tie`` (else by 0); rows with equal keys keep to one cell, ordered by ``tie``,
    and may be split between shards like any others. An empty table gives no rows. ``rows`` must not have columns
    that begin with ``_ring_``; every other name is free.
    """
    spark = rows.sparkSession
    tied = F.col(tie) if tie else F.lit(0)
    placed = rows.withColumn("_ring_h", F.xxhash64(F.lit(seed).cast("long"), F.when(F.col(key).isNull(), F.xxhash64(tied)).otherwise(F.xxhash64(F.col(key)))))
    placed = cut(placed.withColumn("_ring_cell", F.shiftrightunsigned("_ring_h", 64 - CELL_BITS)))
    counts = {r[0]: r[1] for r in placed.groupBy("_ring_cell").count().collect()}  # 2**CELL_BITS rows at most
    base, segments = [0] * n_shards, []
    for cell, first, past, shard in fill(counts, ring(n_shards, vnodes, seed), capacities(sum(counts.values()), n_shards, slack)):
        segments.append({"cell": cell, "first": first, "past": past, "shard": shard, "base": base[shard]})
        base[shard] += past - first
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(segments)), SEGMENTS)).alias("_ring_s")).select(F.col("_ring_s.cell").alias("_ring_cell"), "_ring_s")
    order = Window.partitionBy("_ring_cell").orderBy("_ring_h", F.col(key), tied)
    ranked = placed.withColumn("_ring_rank", F.row_number().over(order) - 1)
    inside = (F.col("_ring_rank") >= F.col("_ring_s.first")) & (F.col("_ring_rank") < F.col("_ring_s.past"))
    # Bounded: a segment for each cell and node at which a cell's keys were split.
    out = ranked.join(F.broadcast(table), (ranked["_ring_cell"] == table["_ring_cell"]) & inside)
    return out.select(*(rows.columns), F.col("_ring_s.shard").cast("int").alias("shard"), (F.col("_ring_s.base") + F.col("_ring_rank") - F.col("_ring_s.first")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """id, size (UTF-8 bytes of the text and 8; null text: 8), text_crc32 (null text: of no bytes), law, shard, slot."""
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    sized = docs.select(F.col(id_col), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    out = assign_shards(sized, id_col, n_shards, tie="text_crc32", **how)
    return out.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), n_shards=24)


QUERIES = {"op8_ring_sharding": op8_ring_sharding}
SQL: dict[str, str] = {}
