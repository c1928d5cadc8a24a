"""WARC archives as chunked record tables.

Writing: a payload is cut into rows (record, chunk number, bytes) of ``chunk`` bytes at most, and each row is a WARC
record of its own: the first a response, the others continuations with segment numbers, as the format has them. Rows
go out through Spark's text writer (its line end is the end of a record), so archives go to any file system that Spark
knows. Each file is compressed as a whole, so that one task reads it, from start to end.

Reading: lines stream through a parser that goes by Content-Length, whatever bytes payloads hold. It keeps one chunk
and the running SHA-1 of the record, never a whole payload, and gives rows (record, chunk number, bytes), the last with
the digest and length of all.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_shared, hot_safe_lookup, pages, shared_path, small_batches

CHUNK = 1 << 20
#: RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n"
RECORD = "urn:record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(digest: str) -> Column:
    """Upper-case base32 of the column ``digest``, a SHA-1 in hexadecimal: 32 characters of five bits."""
    three = f"cast(conv(substr(rpad({digest}, 42, '0'), i * 5 div 4 + 1, 3), 16, 10) AS int)"
    return F.expr(f"array_join(transform(sequence(0, 31), i -> substr('{BASE32}', (shiftright({three}, 7 - i * 5 % 4) & 31) + 1, 1)), '')")


def with_roles(rows: DataFrame, id_col: str, payload: Column, least: int) -> DataFrame:
    """rows (_id, ...) with _data, _size, _sha1 and _keeper, the largest id with the same payload (if it has ``least`` bytes)."""
    rows = rows.withColumns({"_data": payload})
    rows = rows.withColumns({"_size": F.octet_length("_data").cast("long"), "_sha1": F.sha1("_data"), "_same": F.md5("_data")})
    keys = ["_sha1", "_same", "_size"]
    groups = cut(rows.filter(F.col("_size") >= least).groupBy(*keys).agg(F.max("_id").alias("_keeper"), F.count(F.lit(1)).alias("_copies")).filter("_copies > 1"))
    return hot_safe_lookup(rows, groups, keys, "_copies", F.col("_id")).drop("_copies", "_same")


def write_archives(rows: DataFrame, path: str, id_col: str, payload_col: str, url_col: str | None = None, least: int = 0, chunk: int = CHUNK) -> None:
    """Writes a response or revisit record for each row of rows to gzip files under ``path``.

    Of rows with equal payloads of ``least`` bytes or more, that with the largest id is the response, the others are
    revisits of it; rows that repeat that largest id are responses all. A null payload is empty. A null id is written
    as no number and is never a response for others. A null address is written as urn:none. Line ends in addresses are
    taken out. Columns other than those named are not written.
    """
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", "") if url_col else F.lit("")
    slim = rows.select(F.col(id_col).alias("_id"), F.when(url == "", "urn:none").otherwise(url).alias("_url"), F.col(payload_col).cast("binary").alias("_payload"))
    slim = with_roles(slim, "_id", F.coalesce(F.col("_payload"), F.lit("").cast("binary")), least)
    revisit = F.col("_keeper").isNotNull() & ~F.col("_keeper").eqNullSafe(F.col("_id"))
    name = lambda c: F.concat(F.lit(f"<{RECORD}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    chunks = F.when(revisit, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("_size") / chunk))).cast("int")
    # One array of slices, so that the rows which come of it hold their own bytes only.
    slices = F.expr(f"IF(_revisit, array(X''), transform(sequence(0, _chunks - 1), k -> substring(_data, 1 + k * {chunk}, {chunk})))")
    rows = slim.withColumns({"_revisit": revisit, "_chunks": chunks})
    rows = rows.select("_id", "_url", "_size", "_sha1", "_keeper", "_revisit", "_chunks", F.posexplode(slices).alias("_k", "_part"))
    part = F.col("_part")
    block = F.when(F.col("_k") == 0, F.concat(F.lit(HTTP).cast("binary"), part)).otherwise(part)
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(END))
    many, last = F.col("_chunks") > 1, F.col("_k") == F.col("_chunks") - 1
    head = F.concat(
        F.lit("WARC/1.1" + END),
        line("WARC-Type", F.when(F.col("_revisit"), "revisit").when(F.col("_k") > 0, "continuation").otherwise("response")),
        line("WARC-Record-ID", F.when(F.col("_k") == 0, name(F.col("_id"))).otherwise(F.concat(F.lit("<urn:segment:"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), F.col("_k").cast("string"), F.lit(">")))),
        line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.col("_url")),
        F.when(F.col("_k") == 0, F.concat(line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex("_sha1"))), line("Content-Type", F.lit("application/http;msgtype=response")))).otherwise(""),
        F.when(F.col("_revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("_keeper"))))).otherwise(""),
        F.when(many, line("WARC-Segment-Number", (F.col("_k") + 1).cast("string"))).otherwise(""),
        F.when(many & (F.col("_k") > 0), line("WARC-Segment-Origin-ID", name(F.col("_id")))).otherwise(""),
        F.when(many & (F.col("_k") > 0) & last, line("WARC-Segment-Total-Length", (F.col("_size") + len(HTTP)).cast("string"))).otherwise(""),
        line("Content-Length", F.octet_length("_block").cast("string")),
        F.lit(END),
    )
    out = rows.withColumn("_block", block).select(F.concat(head.cast("binary"), F.col("_block"), F.lit(END).cast("binary")).cast("string").alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").text(path)


class ArchiveParser:
    """Rows (id, record type, refers to, chunk number, bytes, last, length, digest) from an archive's lines, in order.

    Versions 1.0 and 1.1. Records that aren't responses, their continuations or revisits are passed over, as are
    digests other than SHA-1 in base32 (nothing is checked then). ``end`` raises if the archive ends inside a record.
    """

    def __init__(self) -> None:
        self.head: dict[str, str] | None = None
        self.need, self.block, self.record, self.body = 0, bytearray(), None, False

    def feed(self, line: bytes) -> Iterator[tuple]:
        """A line without its line feed; gives the rows that it ends."""
        if not self.need:
            text = line.rstrip(b"\r")
            if self.head is None:
                if text and not re.fullmatch(rb"WARC/1\.[01]", text):
                    raise ValueError(f"a record was expected, not {bytes(text[:60])!r}")
                self.head = {} if text else None
            elif text:
                key, _, value = text.decode("utf-8", "replace").partition(":")
                self.head[key.strip().lower()] = value.strip()
            else:
                self.need = int(self.head["content-length"]) + 4  # and two line ends
                self.begin(self.head)
            return
        size = len(line) + 1
        if self.body:
            self.block += line
            self.block += b"\n"
            past = min(size, 4 - (self.need - size))  # bytes of the line ends after the block
            if past > 0:
                del self.block[-past:]
        self.need -= size
        if self.need < 0:
            raise ValueError("a record is longer than it says")
        yield from self.rows(not self.need)
        if not self.need:
            self.head, self.block = None, bytearray()

    def end(self) -> None:
        if self.head is not None:
            raise ValueError(f"the archive ends inside the record {self.head.get('warc-record-id')}")

    def begin(self, head: dict[str, str]) -> None:
        kind = head.get("warc-type", "").lower()
        self.body, self.skip = kind in ("response", "continuation") and (kind == "response" or self.record is not None), kind == "response"
        if kind == "response":
            digest = head.get("warc-payload-digest", "")
            self.record = [self.number(head["warc-record-id"]), 0, hashlib.sha1(), 0, digest.removeprefix("sha1:").upper() if digest.startswith("sha1:") else None]
            if "http" not in head.get("content-type", ""):
                self.skip = False

    def rows(self, done: bool) -> Iterator[tuple]:
        head = self.head
        if not self.body:
            if done and head.get("warc-type", "").lower() == "revisit":
                digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                yield self.number(head["warc-record-id"]), "revisit", self.number(head.get("warc-refers-to", "")), 0, b"", True, None, digest
            return
        if self.skip:  # the lines of HTTP before the payload
            at = self.block.find(b"\r\n\r\n")
            if at < 0 and not done:
                return
            del self.block[: at + 4 if at >= 0 else 0]
            self.skip = False
        while len(self.block) > CHUNK:
            yield self.chunk(bytes(self.block[:CHUNK]), False)
            del self.block[:CHUNK]
        if done:
            segmented = int(head.get("warc-segment-number", 0)) > 0 and "warc-segment-total-length" not in head
            yield self.chunk(bytes(self.block), not segmented)

    def chunk(self, data: bytes, last: bool) -> tuple:
        record = self.record
        record[2].update(data)
        record[3] += len(data)
        digest = base64.b32encode(record[2].digest()).decode() if last else None
        if last and record[4] and len(record[4]) == len(digest) and digest != record[4]:
            raise ValueError(f"record {record[0]}: its payload has the digest {digest}, not {record[4]}")
        row = record[0], "response", None, record[1], data, last, record[3], digest
        record[1] += 1
        return row

    @staticmethod
    def number(name: str) -> str | None:
        return name.strip("<>").removeprefix(RECORD) or None


READ = "_id string, record_type string, _to string, chunk_no int, data binary, last boolean, payload_bytes bigint, payload_digest string"


def read_chunks(spark: SparkSession, path: str, data: bool = True) -> DataFrame:
    """The chunk table of the archives under ``path``; without ``data``, only each record's last row, without bytes.

    An archive that ends inside a record, or whose payload doesn't have its digest, fails the job.
    """
    small_batches(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("_file"), F.col("value").cast("binary").alias("_line"))
    types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.bool_(), pa.int64(), pa.string())
    names = [f.split()[0] for f in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, parser, rows, size = None, ArchiveParser(), [], 0
        for batch in batches:
            for at, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if at != file:
                    parser.end()
                    file, parser = at, ArchiveParser()
                for row in parser.feed(line.as_py()):
                    if data or row[5]:
                        rows.append(row if data else (*row[:4], None, *row[5:]))
                        size += len(rows[-1][4] or b"") + 100
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, size = [], 0
        parser.end()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return lines.mapInArrow(run, READ)


def read_records(spark: SparkSession, path: str, id_col: str = "page_id", id_type: T.DataType | str = "bigint") -> DataFrame:
    """id, payload_bytes, payload_digest, record_type, refers_to of each record; a revisit has its response's length."""
    last = cut(read_chunks(spark, path, data=False).select(F.col("_id").cast(id_type).alias("_id"), "record_type", F.col("_to").cast(id_type).alias("_to"), "payload_bytes", "payload_digest"))
    visits = last.filter("record_type = 'revisit'").groupBy("_to").agg(F.count(F.lit(1)).alias("_n"))
    # Rows that repeat a response's id have its payload, so any of them tells the length.
    sizes = last.filter("record_type = 'response'").groupBy(F.col("_id").alias("_to")).agg(F.max("payload_bytes").alias("_size"))
    found = hot_safe_lookup(last, cut(visits.join(sizes, "_to")), ["_to"], "_n", F.col("_id"))
    return found.select(F.col("_id").alias(id_col), F.coalesce("payload_bytes", "_size").alias("payload_bytes"), "payload_digest", "record_type", F.col("_to").alias("refers_to"))


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(pages(spark, sf_dir), path, "page_id", "html", "url")
    out = cut(read_records(spark, path))
    drop_shared(spark, path)
    return out


QUERIES = {"op6_warc_chunks": op6_warc_chunks}
SQL = {
    "op6_warc_chunks": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS data FROM pages),
d AS (SELECT page_id, octet_length(data) AS payload_bytes, sha1(data) || '00' AS h, max(page_id) OVER (PARTITION BY data) AS keeper FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', (((('0x' || substr(h, i * 5 // 4 + 1, 3))::INT >> (7 - i * 5 % 4)) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""
}
