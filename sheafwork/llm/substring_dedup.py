"""Substring dedup by level-wise doubling: runs of words that repeat at one length alone are extended to twice that length.

Lengths double (each is half the next one, rounded up) from SEED words or fewer to the window: 13, 25, 50. The shortest
runs are seeds: of those inside each window the one with the least hash stands for it (equal windows have equal ones, so
none is lost). The next length is looked at within windows whose seed was found in another document. From then on a run
is a candidate only if both its halves, the run of the length before at its start and the one at its end, were found in
another document. This goes on until no candidate survives or the window is reached; there a run goes if it also starts
in a document with a smaller id. Every level writes one row for each document and run, and texts meet what survived of
them by id. Seeds and halves are told apart by 64 bits of hash, windows by 96.

Runs with more than one row in HOT_KEYS, estimated on a sample which decides this way alone, go through a partial
aggregate and a broadcast of fewer than HOT_KEYS rows; all others are sorted by hash and streamed, one row held at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Kept
from .common import HOT_KEYS, cut, documents, drop_shared, free_finished, small_batches, write_shared

#: Odd multipliers of two polynomial hashes modulo 2**64 (any would do), and of the finalising mix.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
MASK = (1 << 64) - 1
OUT_ROWS = 1 << 15
#: Words of the shortest runs, at most.
SEED = 16
#: Part of a level's rows on which hot runs are looked for.
SAMPLE = 1 / 16


def doubling(window: int) -> list[int]:
    """The lengths of the levels, up to the window."""
    lengths = [window]
    while lengths[0] > SEED:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of a base and of its inverse modulo 2**64, as far as was asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, self.base, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, self.inverse, np.uint64)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


class Runs:
    """Hashes of all runs of so many words in a text."""

    def __init__(self) -> None:
        self.powers = [Powers(b) for b in BASES]
        self.hash_of = Kept(xxhash.xxh64_intdigest)

    def numbers(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        return np.fromiter(map(self.hash_of.__getitem__, words), np.uint64, len(words))

    def runs(self, numbers: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        n = len(numbers)
        if n < length:
            return np.empty(0, np.uint64)
        up, down = self.powers[which].upto(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((numbers if which == 0 else mixed(numbers)) * up[:n], out=total[1:])
        return mixed((total[length:] - total[:-length]) * down[: n - length + 1])

    def seeds(self, numbers: np.ndarray, length: int, window: int) -> np.ndarray:
        """For each window, the least hash of the runs in it."""
        low, width, span = self.runs(numbers, length), window - length + 1, 1
        if len(low) < width:
            return np.empty(0, np.uint64)
        n = len(low) - width + 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        return np.minimum(low[:n], low[width - span : width - span + n])

    def candidates(self, numbers: np.ndarray, alive: np.ndarray, lengths: list[int], level: int) -> np.ndarray:
        """Where the runs of a level start whose shorter runs are alive."""
        window, length, before = lengths[-1], lengths[level], lengths[level - 1]
        if level == 1:
            at = np.isin(self.seeds(numbers, before, window), alive).astype(np.int64)
            inside = np.concatenate([at, np.zeros(window - length, np.int64)])  # in a window that starts here or a little before
            total = np.concatenate([[0], np.cumsum(inside)])
            first = np.maximum(np.arange(len(inside)) - (window - length), 0)
            return np.flatnonzero(total[1:] > total[first]) if len(at) else at
        half = np.isin(self.runs(numbers, before), alive)
        shift = length - before
        return np.flatnonzero(half[:-shift] & half[shift:])


@lru_cache(1)
def hasher() -> Runs:
    return Runs()


ROW = "_ha bigint, _hb int, _id "


def level_rows(docs: DataFrame, lengths: list[int], level: int, kind: str) -> DataFrame:
    """(_ha, _hb, _id): the runs of a level in each document, each once. docs: (_id, _text) and, after level 0, _alive."""

    def found(text: str | None, alive: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
        h = hasher()
        numbers = h.numbers(text)
        if level == 0:
            a = np.unique(h.seeds(numbers, lengths[0], lengths[-1]))
            at = None
        else:
            at = h.candidates(numbers, np.array(alive, np.int64).view(np.uint64), lengths, level)
            a, first = np.unique(h.runs(numbers, lengths[level])[at], return_index=True)
            at = at[first]
        if level < len(lengths) - 1 or at is None:
            return a.view(np.int64), np.zeros(len(a), np.int32)
        return a.view(np.int64), (h.runs(numbers, lengths[level], 1)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            alive = batch.column(2).to_pylist() if level else [None] * len(texts)
            rows = [found(t, x) for t, x in zip(texts, alive, strict=True)]
            places = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
            a, b = (np.concatenate([r[k] for r in rows]) if rows else np.empty(0, t) for k, t in ((0, np.int64), (1, np.int32)))
            for at in range(0, len(a), OUT_ROWS):
                part = slice(at, at + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(a[part]), pa.array(b[part]), batch.column(0).take(pa.array(places[part]))], names=["_ha", "_hb", "_id"])

    return docs.mapInArrow(run, ROW + kind)


def shared_runs(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """From rows sorted by hash and id, (_ha, _id) of those in two documents; at the last level of all but the first."""
    key, first, shown = None, None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        goes_on = (a[0], b[0]) == key
        start = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        firsts = ids[start]
        if goes_on:
            firsts = np.where(start == 0, first, firsts)
        keep = ids > firsts
        met = np.unique(start[keep])
        if not last:
            if goes_on and not shown and len(met) and met[0] == 0:
                yield pa.RecordBatch.from_arrays([pa.array([a[0]], pa.int64()), pa.array([first], batch.schema.field(2).type)], names=["_ha", "_id"])
            keep[met[1:] if goes_on and len(met) and met[0] == 0 else met] = True
        shown = (len(met) > 0 and met[-1] == start[-1]) or (shown and goes_on and start[-1] == 0)
        key, first = (a[-1], b[-1]), firsts[-1]
        out = pa.array(np.flatnonzero(keep))
        if len(out):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(out), batch.column(2).take(out)], names=["_ha", "_id"])


def survivors(rows: DataFrame, last: bool, kind: str) -> DataFrame:
    """(_id, _alive): each document's runs that are in another one too; at the last level, in one with a smaller id."""
    sample = rows.sample(False, SAMPLE, 7)
    size = sample.count()
    counts = sample.groupBy("_ha", "_hb").agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) & (F.col("_n") * HOT_KEYS > size))
    hot = cut(counts.select("_ha", "_hb"))
    calm = rows.join(F.broadcast(hot), ["_ha", "_hb"], "left_anti") if hot.limit(1).count() else rows
    out = calm.repartition("_ha", "_hb").sortWithinPartitions("_ha", "_hb", "_id").mapInArrow(lambda b: shared_runs(b, last), f"_ha bigint, _id {kind}")
    if calm is not rows:
        busy = rows.join(F.broadcast(hot), ["_ha", "_hb"], "left_semi")
        met = cut(busy.groupBy("_ha", "_hb").agg(F.min("_id").alias("_a"), F.max("_id").alias("_z")).filter("_a < _z"))
        out = out.unionByName(busy.join(F.broadcast(met), ["_ha", "_hb"]).filter("_id > _a" if last else "true").select("_ha", "_id"))
    return cut(out.groupBy("_id").agg(F.collect_set("_ha").alias("_alive")))


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(_id, _alive): hashes of the windows that also start in a document with a smaller id. docs: (_id, _text), no null ids."""
    spark, kind, lengths = docs.sparkSession, dict(docs.dtypes)["_id"], doubling(window)
    hits = None
    for level in range(len(lengths)):
        texts = docs if hits is None else docs.join(hits, "_id")
        rows, path = write_shared(level_rows(texts, lengths, level, kind), "runs")
        del texts
        free_finished(spark)  # the texts' shuffle goes before the runs move
        hits = survivors(rows, level == len(lengths) - 1, kind)
        drop_shared(spark, path)
        free_finished(spark)
        if not hits.limit(1).count():
            break
    return hits


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """id, n_words, n_removed, kept_sha256; with ``texts`` also kept_text and removed, the word spans [from, to) taken out.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller id. Words are
    runs without ASCII white space; kept words are joined by one space. A null text has no words. A null id is neither
    smaller nor larger than another: such documents stay whole. Rows with equal ids are one document's for this purpose
    and don't remove each other; each comes back. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    gone = repeated_windows(slim.filter("_id IS NOT NULL"), window)
    schema = f"_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string, removed array<struct<first: int, past: int>>" * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, text, alive in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                at = np.flatnonzero(np.isin(hasher().runs(hasher().numbers(text), window), np.array(alive, np.int64).view(np.uint64))).tolist() if alive else ()
                spans: list[list[int]] = []
                for p in at:
                    if spans and p <= spans[-1][1]:
                        spans[-1][1] = p + window
                    else:
                        spans.append([p, p + window])
                kept, done = [], 0
                for first, past in spans:
                    kept += words[done:first]
                    done = min(past, len(words))
                kept += words[done:]
                data = b" ".join(kept)
                row = {"_id": id_, "n_words": len(words), "n_removed": len(words) - len(kept), "kept_sha256": hashlib.sha256(data).hexdigest()}
                if texts:
                    row |= {"kept_text": data.decode("utf-8", "surrogatepass"), "removed": [{"first": a, "past": min(b, len(words))} for a, b in spans]}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=out_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = to_arrow_schema(_parse_datatype_string(schema))
    out = slim.join(gone, "_id", "left").select("_id", "_text", "_alive").mapInArrow(run, schema)
    return out.withColumnRenamed("_id", id_col)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), window=50, texts=False)


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
SQL = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM d WHERE len(ws) >= 50),
keyed AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM win),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM keyed) WHERE doc_id > m),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(len(ks), 0) AS n_removed,
       sha256(CASE WHEN ks IS NULL THEN array_to_string(ws, ' ') ELSE
         coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda k: NOT list_contains(ks, k)), lambda k: ws[k]), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
}
