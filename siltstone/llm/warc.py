r"""WARC archives: writing with segmentation and revisits, reading with reassembly.

Writing: every row becomes a record of an HTTP message. Rows with equal payloads are stored once: the row
with the largest id is the response, the others are revisits that refer to it. A record's name holds the row's
key and its payload's digest; rows that agree in both get a number besides, so that no two records of a run share a name. The body travels in
chunked transfer coding; a block over ``segment_bytes`` is cut into a first record (segment 1) and
continuation records that name it as their origin, the last with the total length.

Who revisits whom is found from keys, lengths and digests alone. It is told to the rows by key and digest: as a broadcast
up to ``TOLD_ROWS`` of them (counted, some 80 bytes each), by a join beyond.

Reading: archives are parsed as a stream, record by record, by Content-Length. Segmented records are
grouped by their origin's name, ordered by segment number, their total length verified, and only then is the HTTP
message parsed and the chunk framing decoded. Only segments are shuffled, and one group is one record.

Archives are written by Spark's text sink (records end with the CRLF CRLF that the format asks for), so they
can be on any store Spark writes to; gzip is applied per file. An archive holds a bounded number of records of
bounded length.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.frames import discard, named, salted_join, saved, shared_dir, tidy

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
#: Bytes of payload for each archive, and records in one archive at most: with segments of 32 KiB, 256 MiB before compression.
ARCHIVE_BYTES = 32 << 20
ARCHIVE_RECORDS = 8192
#: Rows that are told something about themselves, up to which they are broadcast.
TOLD_ROWS = 100_000
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    """Base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer coding."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for i in range(0, len(payload), size) if (c := payload[i : i + size])]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        eol = body.find(b"\r\n", at)
        if eol < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:eol].split(b";")[0], 16)
        at = eol + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk shorter or longer than its size")
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the CRLF CRLF that ends it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def _clean(text: str | None) -> str:
    return "".join(c for c in text or "" if c not in "\r\n")


def name_of(key: int | None, digest: str, number: str | None = None) -> str:
    """The name of a record: of its key (null: none), its payload's digest and a number if these aren't enough."""
    return f"<urn:page:{'' if key is None else key}:{digest}{'' if number is None else f':{number}'}>"


def records_of(key: int | None, url: str | None, payload: bytes, refers: int | None, segment_bytes: int = SEGMENT_BYTES, number: str | None = None) -> Iterator[bytes]:
    """The records of one page: a response, segmented if its block is long, or a revisit."""
    digest = digest_of(payload)
    uri = name_of(key, digest, number)
    sha = f"sha1:{digest}"
    common = [("WARC-Record-ID", uri), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", sha)]
    if refers is not None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name_of(refers, digest))]
        yield _record([("WARC-Type", "revisit"), *common, *more, ("Content-Type", "application/http;msgtype=response")], http)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    typed = [("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *common, *typed], block)
        return
    starts = range(0, len(block), segment_bytes)
    for at_number, at in enumerate(starts, 1):
        part = block[at : at + segment_bytes]
        if at_number == 1:
            yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1"), *typed], part)
            continue
        head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{uri[:-1]}/{at_number}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", uri), ("WARC-Segment-Number", str(at_number))]
        if at_number == len(starts):
            head.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(head, part)


def _told(marks: DataFrame, min_bytes: int) -> DataFrame:
    """What rows must be told, by key (null included) and digest: ``head``, the key they refer to, if they are revisits,
    and ``again``, whether several rows share key and payload."""
    each = marks.groupBy("key", "sha", "n").agg(F.count(F.lit(1)).alias("times"))
    heads = each.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.max("key").alias("head"), F.sum("times").alias("many")).where("many > 1").drop("many")
    again = (F.col("times") > 1).alias("again")
    # A null key is never the largest; where all are null each is a response.
    equal = salted_join(each.where(F.col("n") >= min_bytes), heads, ["sha", "n"], "key")
    equal = equal.select("key", "sha", F.expr("if(key IS NULL OR key < head, head, NULL)").alias("head"), again).where("head IS NOT NULL OR again")
    small = each.where((F.col("n") < min_bytes) & (F.col("times") > 1)).select("key", "sha", F.lit(None).cast("long").alias("head"), again)
    return equal.unionByName(small)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, archive_records: int = ARCHIVE_RECORDS, null_keys: bool = False, told_rows: int = TOLD_ROWS) -> None:
    """Write one record per row as gzipped archives in the folder ``path``.

    Of rows whose payloads (UTF-8 of ``html``; null: empty) are equal and have at least ``min_bytes`` bytes, the
    one with the largest key is the response and the others are revisits; smaller payloads are all
    responses. Each row is a record: rows that share a key but not the payload are told apart by the digest, rows that share
    both are as many responses (if the key is the largest) or revisits. Rows with a null key raise an error,
    unless ``null_keys``: then each is a revisit of the row with the largest key and an equal payload, or a response if there is
    none. Line breaks in urls are left out. An empty table writes archives without records; other columns are left out.
    """
    body = F.coalesce(named(html).cast("string"), F.lit("")).cast("binary")
    own = named(key).cast("long")
    if not null_keys:
        own = F.when(named(key).isNull(), F.raise_error(F.lit("a page without a key can't be written"))).otherwise(own)
    rows = pages.select(own.alias("key"), named(url).cast("string").alias("url"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("sha"))
    folder = shared_dir(pages.sparkSession)
    marks = saved(rows.select("key", "sha", F.length("body").alias("n")), "marks", folder)
    told = saved(_told(marks, min_bytes), "told", folder)
    few = told.count() <= told_rows
    told = told.withColumnsRenamed({"key": "told_key", "sha": "told_sha"})
    joined = rows.join(F.broadcast(told) if few else told.hint("merge"), F.col("key").eqNullSafe(F.col("told_key")) & (F.col("sha") == F.col("told_sha")), "left")
    schema = T.StructType([T.StructField("record", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for b in batches:
            made: list[bytes] = []
            held = 0
            for i in range(b.num_rows):
                k, u, p, h, again = (b.column(c)[i].as_py() for c in range(5))
                at += 1
                for r in records_of(k, u, p, h, segment_bytes, f"{task}.{at}" if again or k is None else None):
                    made.append(r)
                    held += len(r)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])
                    made, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    # A number of archives that follows the bytes, not the partitions of the input.
    size = marks.agg(F.sum("n")).first()[0] or 0
    n = max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // ARCHIVE_BYTES))
    records = joined.select("key", "url", "body", "head", "again").coalesce(n).mapInArrow(tidy(run), schema)
    records.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", archive_records).text(path)
    discard(pages.sparkSession, folder)


@dataclass
class Record:
    """A parsed record."""

    headers: dict[str, str]
    block: bytes


class _Stream:
    """Bytes of an archive, unzipped as they are asked for (one or more gzip members, or plain)."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at, self.have = memoryview(raw), 0, bytearray()
        self.plain = bytes(raw[:2]) != b"\x1f\x8b"
        self.unzip = None if self.plain else zlib.decompressobj(31)

    def more(self) -> bool:
        if self.at >= len(self.raw) and (self.plain or not self.unzip.unconsumed_tail):
            return False
        piece = self.raw[self.at : self.at + (1 << 18)]
        self.at += len(piece)
        if self.plain:
            self.have += piece
            return True
        self.have += self.unzip.decompress(piece)
        while self.unzip.eof and (rest := self.unzip.unused_data or b""):
            self.unzip = zlib.decompressobj(31)
            self.have += self.unzip.decompress(rest)
        if self.unzip.eof and self.at < len(self.raw):
            self.unzip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.have.find(mark, start)) < 0:
            start = max(0, len(self.have) - len(mark))
            if not self.more():
                return None
        out = bytes(self.have[:i])
        del self.have[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def parse(raw: bytes) -> Iterator[Record]:
    """The records of an archive, one after the other."""
    s = _Stream(raw)
    while True:
        head = s.until(END)
        if head is None:
            if s.have.strip():
                raise ValueError("the archive ends inside a record's headers")
            return
        lines = head.decode().lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = s.take(int(headers["content-length"]))
        if s.take(4) != END:
            raise ValueError("a record's length isn't its block's")
        yield Record(headers, block)


def payload_of(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers and decoded body of a block."""
    head, _, body = block.partition(END)
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return headers, unchunked(body) if "chunked" in headers.get("transfer-encoding", "").lower() else body


def _key(urn: str | None) -> int | None:
    """The key in a name of ``name_of``; null for other names."""
    parts = (urn or "").strip("<>").split(":")
    return int(parts[2]) if parts[:2] == ["urn", "page"] and len(parts) > 2 and parts[2].lstrip("-").isdigit() else None


READ_SCHEMA = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
    ]
)
_PARSED = T.StructType([*READ_SCHEMA, T.StructField("origin", T.StringType()), T.StructField("segment", T.IntegerType()), T.StructField("total", T.LongType()), T.StructField("block", T.BinaryType())])
_ARROW = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])


def _finished(headers: dict[str, str], block: bytes, payloads: bool) -> dict:
    http, payload = payload_of(block)
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and told and told != digest_of(payload):
        raise ValueError(f"the payload of {headers['warc-record-id']} doesn't have its digest")
    size = len(payload) if kind == "response" else int(http.get("content-length", 0))
    return {
        "key": _key(headers["warc-record-id"]),
        "url": headers.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _key(headers.get("warc-refers-to")),
        "payload": payload if payloads and kind == "response" else None,
        "payload_bytes": size,
        "payload_digest": told or digest_of(payload),
    }


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per response or revisit record of the archives in a folder: key, url, record_type, refers_to,
    payload (null for revisits, and for all if ``payloads`` is false), payload_bytes and payload_digest (of the
    full payload, for revisits as recorded).

    A wrong length, a missing segment, broken chunk framing or a payload without its digest raises an
    error. Records of other types are passed over. The key is null if a record's name isn't one that ``write_warc``
    gives, or the row had none. A folder without records gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out: list[dict] = []
                held = 0
                for r in parse(b.column(0)[i].as_py()):
                    h = r.headers
                    kind = h.get("warc-type")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    if "warc-segment-number" in h:
                        origin = h.get("warc-segment-origin-id") or h["warc-record-id"]
                        row = {"origin": origin, "url": h.get("warc-target-uri"), "record_type": kind, "payload_digest": h.get("warc-payload-digest"), "segment": int(h["warc-segment-number"]), "block": r.block}
                        row["total"] = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
                    else:
                        row = _finished(h, r.block, payloads)
                    out.append(row)
                    held += len(r.block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    def join(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("segment")
        numbers = g["segment"].tolist()
        total = g["total"].iloc[-1]
        block = b"".join(g["block"])
        if numbers != list(range(1, len(numbers) + 1)) or pd.isna(total) or int(total) != len(block):
            raise ValueError(f"record {g['origin'].iloc[0]}: segments {numbers} with {len(block)} bytes don't make up {total}")
        first = g.iloc[0]
        headers = {"warc-type": "response", "warc-record-id": first["origin"], "warc-payload-digest": first["payload_digest"] or ""}
        if first["url"] is not None:
            headers["warc-target-uri"] = first["url"]
        made = pd.DataFrame([_finished(headers, block, payloads)])
        made[["key", "refers_to"]] = made[["key", "refers_to"]].astype("Int64")
        return made

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    parsed = files.mapInArrow(tidy(run), _PARSED)
    whole = parsed.where("segment IS NULL").select(*READ_SCHEMA.names)
    joined = parsed.where("segment IS NOT NULL").groupBy("origin").applyInPandas(join, READ_SCHEMA)
    return whole.unionByName(joined)
