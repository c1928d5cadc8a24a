"""SimHash near-dedup with BK-trees.

Documents become fingerprints; equal fingerprints are one node. Nodes meet in shards, and each shard has a BK-tree
(children keyed by their Hamming distance to the parent; a search follows only the edges within the radius). Each node
links to what its shard's tree holds within the radius; a shard gives a spanning forest of its links, never all pairs.
Components of the forest come from rounds of joins (components.py's stars), with a checkpoint each.

Shards of 64-bit fingerprints: cut into radius + 2 blocks, two fingerprints within the radius agree in two blocks at
least; so each pair of blocks and their values is a shard, and no link is lost. The bits that a shard leaves open are
cut in the same way if it has more than TREE nodes, until FREE_BITS or fewer are open: so a tree has 2**FREE_BITS
nodes at most, however many documents share their bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, documents, hot_safe_lookup, small_batches
from .components import component_labels

#: Shards with more nodes are cut again, if they leave more than FREE_BITS bits open.
TREE, FREE_BITS = 20_000, 16
#: Shingles whose bits are counted at once.
BLOCK = 1 << 14


def shingle_hashes(text: str, n: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of n words (ASCII letters in lower case); of the whole sequence if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if n == 3 and len(words) >= 3:
        return np.array([digest(b"%b %b %b" % w, seed) for w in zip(words, words[1:], words[2:], strict=False)], np.uint64)
    return np.array([digest(join(words[i : i + n]), seed) for i in range(max(1, len(words) - n + 1))], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; 0 if there are none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


class BkTree:
    """Integers by Hamming distance: the child at distance d of a node holds all that are as far from it."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, value: int, item: int) -> None:
        if self.root is None:
            self.root = [value, item, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = [value, item, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[tuple[int, int]]:
        stack = [self.root] if self.root else []
        while stack:
            v, item, children = stack.pop()
            d = (v ^ value).bit_count()
            if d <= radius:
                yield item, d
            if children:
                if len(children) <= 2 * radius:
                    stack += [c for e, c in children.items() if d - radius <= e <= d + radius]
                else:
                    stack += [children[e] for e in range(max(0, d - radius), d + radius + 1) if e in children]


class Forest:
    """Union-find over the places of a shard; tells which links join two parts."""

    def __init__(self) -> None:
        self.up: list[int] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class Shard:
    """The tree of one shard, and the parts that its links make."""

    def __init__(self, radius: int) -> None:
        self.tree, self.forest, self.parts, self.radius, self.names = BkTree(), Forest(), 0, radius, []

    def links(self, value: int, name) -> Iterator[tuple]:
        """Links (name, name) of a new node that join parts: with those of all nodes, a spanning forest.

        Once the node is linked and all of the tree is one part, further links of it would join nothing: its search ends.
        """
        i, joined = len(self.names), 0
        self.forest.up.append(i)
        self.names.append(name)
        for j, _ in self.tree.within(value, self.radius):
            if self.forest.join(i, j):
                joined += 1
                yield self.names[j], name
            if joined and self.parts == joined:
                break
        self.parts += 1 - joined
        self.tree.add(value, i)


def tree_links(sharded: DataFrame, radius: int) -> DataFrame:
    """(_a, _b): links between the names of each shard, from rows (_k, _key, _name: fingerprint) with few nodes a shard."""
    kind = dict(sharded.dtypes)["_name"]
    by = Window.partitionBy("_k", "_key")
    rows = sharded.withColumn("_n", F.count(F.lit(1)).over(by)).filter("_n > 1").select("_k", "_key", "_name")
    types = {"bigint": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, Shard(radius)
        for batch in batches:
            found = []
            for k, at, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, at) != key:
                    key, shard = (k, at), Shard(radius)
                found += shard.links(int.from_bytes(name, "big") if kind == "binary" else name & (1 << 64) - 1, name)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, types[kind]) for c in zip(*found, strict=True)], names=["_a", "_b"])

    return rows.sortWithinPartitions("_k", "_key", "_name").mapInArrow(run, f"_a {kind}, _b {kind}")


def shard_levels(radius: int) -> Iterator[list[tuple[int, int]]]:
    """For each level of shards, (place of its parent in the level before, mask of the bits that agree)."""
    masks = [0]
    while max(64 - m.bit_count() for m in masks) > FREE_BITS:
        level = []
        for parent, mask in enumerate(masks):
            free = [k for k in range(64) if not mask >> k & 1]
            n = radius + 2
            edges = [len(free) * i // n for i in range(n + 1)]
            blocks = [sum(1 << k for k in free[edges[i] : edges[i + 1]]) for i in range(n)]
            level += [(parent, mask | x | y) for x, y in combinations(blocks, 2)]
        yield level
        masks = [m for _, m in level]


def near_links(nodes: DataFrame, radius: int) -> DataFrame:
    """(_a, _b): a spanning forest of the nodes (_fp, each once) that differ in ``radius`` bits or fewer."""
    signed = lambda m: F.lit(m - (m >> 63 << 64))
    rows, out = nodes.select("_fp", F.lit(0).alias("_k")), None
    for level in shard_levels(radius):
        keys = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(k).alias("_k"), F.col("_fp").bitwiseAND(signed(m)).alias("_key")) for k, (p, m) in enumerate(level)))
        rows = rows.select(F.col("_fp").alias("_name"), F.inline(F.filter(keys, lambda s: s["p"] == F.col("_k")))).select("_k", "_key", "_name")
        deepest = max(64 - m.bit_count() for _, m in level) <= FREE_BITS
        large = None if deepest else cut(rows.groupBy("_k", "_key").agg(F.count(F.lit(1)).alias("_n")).filter(f"_n > {TREE}"))
        if large is None or large.isEmpty():
            links = tree_links(rows, radius)
            return out.unionByName(links) if out else links
        rows = hot_safe_lookup(rows, large, ["_k", "_key"], "_n", F.col("_name"))
        links = tree_links(rows.filter("_n IS NULL").drop("_n"), radius)
        out = out.unionByName(links) if out else links
        rows = rows.filter("_n IS NOT NULL").select(F.col("_name").alias("_fp"), "_k")
    raise AssertionError("the deepest level ends the loop")


def fingerprints(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _fp): 64-bit SimHash as a long."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority(shingle_hashes(t or "", n)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["_id", "_fp"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"_id {kind}, _fp bigint")


def with_components(prints: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """prints (_id, _fp) with _component, the smallest id of the nodes that links join."""
    named = nodes.join(labels, nodes["_fp"] == labels["_node"], "left").select("_fp", "_least", "_n", F.coalesce("_root", "_fp").alias("_root"))
    least = cut(named.groupBy("_root").agg(F.min("_least").alias("_component"), F.count(F.lit(1)).alias("_nodes")))
    named = cut(hot_safe_lookup(named, least, ["_root"], "_nodes", F.xxhash64("_fp")).select("_fp", "_n", "_component"))
    return hot_safe_lookup(prints, named, ["_fp"], "_n", F.col("_id"))


def simhash_components(docs: DataFrame, n: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id, the smallest id that links of ``radius`` or fewer bits reach.

    A text without words, and a null text, has fingerprint zero and links like any other. Rows with null ids keep them
    and do not count as smallest unless all of the component have none. Repeated rows come back each; an empty table
    gives no rows. Other columns are ignored.
    """
    prints = cut(fingerprints(docs, n, id_col, text_col))
    nodes = cut(prints.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n")))
    links = near_links(nodes, radius)
    labels = component_labels(links)  # (_node, _root) of linked nodes
    out = with_components(prints, nodes, labels)
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


#: Near copies: sets of words with a Jaccard similarity of so many fifths at least.
NEAR, OF = 4, 5
#: Bits of the wide fingerprint, and bits that may differ between candidates. Near copies have an expected 15 % of
#: differing bits (77, standard deviation 8) at most; the radius leaves four standard deviations above that.
WIDE, WIDE_RADIUS = 512, 110
#: Shards of wide fingerprints: so many keys, each of the least values of so many permutations of the shingles.
KEYS, KEY_SIZE = 16, 4
#: Shingles of one piece of a candidate group (with NODE for each set), and positions of the bitmap of candidates' texts.
PIECE, NODE = 4_000_000, 100
#: Sets of a group that all of its pieces search (about).
PIVOTS = 16
BITMAP, BUCKET = 1 << 23, 1 << 15


@lru_cache(1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(11))
    n = KEYS * KEY_SIZE
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """The wide fingerprint of a set of shingles, and its shard keys."""
    if not len(hashes):
        return bytes(WIDE // 8), [0] * KEYS
    bits = b"".join(majority(mix64(hashes + np.uint64(k))).to_bytes(8, "big") for k in range(WIDE // 64))
    times, plus = permutations()
    least = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at : at + 2048, None] * times + plus).min(axis=0))
    keys = mix64(least).reshape(KEYS, KEY_SIZE)
    total = keys[:, 0]
    for k in range(1, KEY_SIZE):
        total = mix64(total + keys[:, k])
    return bits, total.view(np.int64).tolist()


def set_name(hashes: np.ndarray) -> bytes:
    """128 bits of a sorted set of shingles: equal sets are one node."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is NEAR / OF or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= NEAR * (len(a) + len(b) - both)


class Verified:
    """Sets of a candidate group or piece, and the parts that verified links make of them."""

    def __init__(self) -> None:
        self.names: list[bytes] = []
        self.sets: list[np.ndarray] = []
        self.bits = np.empty((64, WIDE // 64), np.uint64)
        self.sizes, self.parts = np.empty(64, np.int64), np.empty(64, np.int64)
        self.first: dict[bytes, int] = {}

    def links(self, name: bytes, bits: bytes, hashes: np.ndarray, hold: bool) -> Iterator[tuple]:
        """Links of a node, one to each part that has a near copy of it, nearest fingerprints first; then it is held, or not."""
        n, row, size = len(self.names), np.frombuffer(bits, np.uint64), len(hashes)
        far = np.bitwise_count(self.bits[:n] ^ row).sum(axis=1, dtype=np.int64)
        sizes, parts = self.sizes[:n], self.parts[:n]
        left = np.flatnonzero((far <= WIDE_RADIUS) & (OF * sizes >= NEAR * size) & (NEAR * sizes <= OF * size))
        left, part = left[np.argsort(far[left], kind="stable")], n
        while len(left):
            j, left = left[0], left[1:]
            if similar(self.sets[j], hashes):
                yield self.names[j], name
                old = parts[j]
                if part == n:
                    part = old
                else:
                    parts[parts == old] = part
                left = left[parts[left] != part]
        if hold:
            self.hold(name, row, hashes, part)

    def hold(self, name: bytes, row: np.ndarray, hashes: np.ndarray, part: int) -> None:
        n = len(self.names)
        if n == len(self.sizes):
            self.bits, self.sizes, self.parts = np.concatenate([self.bits, self.bits]), np.tile(self.sizes, 2), np.tile(self.parts, 2)
        self.names.append(name)
        self.sets.append(hashes)
        self.bits[n], self.sizes[n], self.parts[n] = row, len(hashes), part

    def known(self, name: bytes, bits: bytes, hashes: np.ndarray, component: bytes) -> None:
        """Holds a node whose part is known, without a search."""
        self.hold(name, np.frombuffer(bits, np.uint64), hashes, self.first.setdefault(component, len(self.names)))


def verified_links(pieces: DataFrame) -> DataFrame:
    """(_a, _b): links that span the near copies in each piece of rows (_root, _tree, _role, _name, _fp, _set, _part).

    Role 0 searches the piece and is held in it, or only held if its _part is known; role 1 only searches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, Verified()
        for batch in batches:
            found = []
            for root, tree, role, name, bits, data, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, tree) != key:
                    key, held = (root, tree), Verified()
                hashes = np.frombuffer(data, np.uint64)
                if part is None or role:
                    found += held.links(name, bits, hashes, role == 0)
                else:
                    held.known(name, bits, hashes, part)
            if found:
                yield pa.RecordBatch.from_pylist([{"_a": a, "_b": b} for a, b in found])

    rows = pieces.select("_root", "_tree", "_role", "_name", "_fp", "_set", "_part").repartition("_root", "_tree")
    return rows.sortWithinPartitions("_root", "_tree", "_role", "_name").mapInArrow(run, "_a binary, _b binary")


def group_links(docs: DataFrame, named: DataFrame, n: int, text_col: str) -> DataFrame:
    """(_a, _b): links that span the near copies in each candidate group of named (_name, _copy, _size, _fp, _root).

    A group with many shingles is cut into pieces. First each piece is searched on its own, together with some PIVOTS
    sets of the group, which tie the pieces' parts to one another. Whatever is then in the largest part of a group needs
    no search for others of it; only the rest searches the other pieces.
    """
    sizes = cut(named.groupBy("_root").agg(F.count(F.lit(1)).alias("_nodes"), F.sum(F.col("_size") + NODE).alias("_weight")).filter("_nodes > 1"))
    members = hot_safe_lookup(named, sizes, ["_root"], "_nodes", F.xxhash64("_name")).filter("_nodes IS NOT NULL")
    members = members.withColumn("_pieces", F.expr(f"(_weight + {PIECE - 1}) div {PIECE}"))
    members = cut(members.withColumn("_piece", F.pmod(F.xxhash64("_name"), F.col("_pieces"))).select("_copy", "_root", "_piece", "_pieces", "_nodes", "_name", "_fp"))
    every = F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)
    pivot = (F.col("_pieces") > 1) & (F.pmod(F.xxhash64("_name", F.lit(1)), F.greatest(F.lit(1), F.expr(f"_nodes div {PIVOTS}"))) == 0)
    first = candidate_sets(docs, members, n, text_col).withColumn("_tree", F.explode(F.when(pivot, every).otherwise(F.array("_piece"))))
    links = cut(verified_links(first.withColumns({"_role": F.lit(0), "_part": F.lit(None).cast("binary")})).distinct())
    cut_up = members.filter("_pieces > 1")
    if cut_up.isEmpty():
        return links
    labels = component_labels(links)
    parts = cut(cut_up.join(labels, cut_up["_name"] == labels["_node"], "left").select(*(cut_up[c] for c in cut_up.columns), F.coalesce(labels["_root"], "_name").alias("_part")))
    tally = parts.groupBy("_root", "_nodes", "_part").agg(F.count(F.lit(1)).alias("_k"))
    largest = cut(tally.groupBy("_root").agg(F.first("_nodes").alias("_all"), F.max_by("_part", "_k").alias("_most")))
    rows = cut(hot_safe_lookup(parts, largest, ["_root"], "_all", F.xxhash64("_name")))
    to = F.when(F.col("_part") == F.col("_most"), F.array("_piece")).otherwise(every)
    again = candidate_sets(docs, rows, n, text_col).withColumn("_tree", F.explode(to))
    more = verified_links(again.withColumn("_role", F.when(F.col("_tree") == F.col("_piece"), 0).otherwise(1)))
    return cut(links.unionByName(more).distinct())


def candidate_sets(docs: DataFrame, members: DataFrame, n: int, text_col: str) -> DataFrame:
    """members (_copy: the MD5 of a text, and others) with _set, the shingles of the text, instead of _copy.

    Only texts whose place in a bitmap of the members is set are shuffled, copies once a task.
    """
    place = F.pmod(F.xxhash64("_copy"), F.lit(BITMAP))
    marks = members.select(place.alias("_at")).groupBy(F.expr(f"_at div {BUCKET}").alias("_bucket"))
    marks = marks.agg(F.bitmap_construct_agg(F.col("_at") % BUCKET).alias("_marks"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    facts = docs.select(text.alias("_text")).withColumn("_copy", F.unhex(F.md5("_text"))).withColumn("_at", place)
    facts = facts.withColumn("_bucket", F.expr(f"_at div {BUCKET}")).join(F.broadcast(marks), "_bucket")
    byte = F.conv(F.hex(F.substring("_marks", F.expr(f"int(_at % {BUCKET} div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    hit = facts.filter(F.floor(byte / F.pow(F.lit(2), F.col("_at") % 8)) % 2 == 1)
    texts = hit.groupBy("_copy", "_text").agg(F.count(F.lit(1)).alias("_k"))
    rest = [c for c in members.columns if c != "_copy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(t, n)).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(sets, pa.binary())], names=[*rest, "_set"])

    kinds = dict(members.dtypes)
    return texts.join(members, "_copy").select("_text", *rest).mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in rest), "_set binary"]))


def candidate_links(shards: DataFrame) -> DataFrame:
    """(_a, _b): links that join the wide fingerprints _name of each shard (_k, _key) that may be near copies.

    Those of a shard's tree; a shard of more than TREE nodes is one group as it stands, as verification decides.
    """
    sizes = cut(shards.groupBy("_k", "_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_name").alias("_b")).filter(f"_n > {TREE}"))
    if sizes.isEmpty():
        return tree_links(shards, WIDE_RADIUS).distinct()
    met = hot_safe_lookup(shards, sizes, ["_k", "_key"], "_n", F.xxhash64("_name"))
    trees = tree_links(met.filter("_n IS NULL").select("_k", "_key", "_name"), WIDE_RADIUS)
    return trees.unionByName(met.filter("_n IS NOT NULL").select(F.col("_name").alias("_a"), "_b")).distinct()


def near_classes(docs: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and component_id, the smallest id that chains of near copies reach: shingles of n words, similarity 0.8 or more.

    For the 64-bit fingerprint a similarity of 0.8 is some ten differing bits, at which no blocks of bits are sure to
    agree and trees visit all nodes. So the fingerprint is wider, and the shards of the trees come from minwise keys of
    the same shingles: two documents with a similarity of 0.8 share a shard with a probability of 0.9998. Links of the
    trees only give groups of candidates: no near copies that share a shard are in different groups. The sets of each
    group meet, and links that span its near copies are those whose similarity, counted exactly, is 0.8 or more. Nulls, empty texts, repeated rows and
    other columns are treated as in simhash_components.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for t in part.column(2).to_pylist():
                    hashes = np.unique(shingle_hashes(t, n))
                    rows.append((set_name(hashes), len(hashes), *sketch(hashes)))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["_id", "_copy", "_name", "_size", "_fp", "_keys"])

    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    texts = texts.select("_id", F.unhex(F.md5("_text")).alias("_copy"), "_text")
    sketches = cut(texts.mapInArrow(run, f"_id {kind}, _copy binary, _name binary, _size bigint, _fp binary, _keys array<bigint>"))
    shards = sketches.select(F.col("_fp").alias("_name"), F.posexplode("_keys").alias("_k", "_key")).distinct()
    groups = component_labels(candidate_links(shards))
    nodes = cut(sketches.groupBy("_name").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"), F.min("_copy").alias("_copy"), F.min("_size").alias("_size"), F.min("_fp").alias("_fp")))
    named = nodes.join(groups, nodes["_fp"] == groups["_node"], "left")
    named = cut(named.select("_name", "_copy", "_size", "_fp", F.coalesce("_root", "_fp").alias("_root")))
    labels = component_labels(group_links(docs, named, n, text_col))
    found = with_components(sketches.select("_id", F.col("_name").alias("_fp")), nodes.select(F.col("_name").alias("_fp"), "_least", "_n"), labels)
    return found.select(F.col("_id").alias(id_col), F.col("_component").alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are near copies of one with a smaller id; rows with null ids stay."""
    found = near_classes(docs, n, id_col, text_col)
    gone = found.filter(F.col(id_col) > F.col("component_id")).select(id_col).distinct()
    return docs.join(cut(gone), id_col, "left_anti").select(*docs.columns)


def op1_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir), n=3, radius=2)


QUERIES = {"op1_simhash_bktree": op1_simhash_bktree}
SQL: dict[str, str] = {}
