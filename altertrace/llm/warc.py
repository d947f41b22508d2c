"""WARC archives: one gzip member per record, written by Spark's file writer and read back by byte ranges.

``write`` puts one record per page into archives: a response with the page, or a revisit where another page has the same
payload and a smaller id. ``read`` is splittable: tasks scan byte ranges of the files for the gzip magic, take a place for
a record only if it decodes to a WARC header and is followed by another member or the end of the file, and own the records
that start inside their range.

Defined results: a null page is empty; a null id, url or payload is no error (a null id reads back as null and never stands
for others; pages without any id are responses); rows that repeat the smallest id of a payload are all responses;
other columns of the input are ignored; an empty table gives archives without records and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from altertrace.llm.text import lean, small_batches

MOST_TASKS = 20_000
RANGE = 32 << 20
READ = 1 << 20
MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member; it parts the records, because Spark's text writer puts a separator behind each row.
EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
DATE = "2024-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
FIELDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def clean(value: str | None) -> str:
    """A header value on one line: line ends and per cent signs are escaped."""
    return re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", value or "")


def plain(value: str) -> str:
    return re.sub(r"%(0D|0A|25)", lambda m: chr(int(m[1], 16)), value)


def record(key: object, url: str | None, payload: bytes, digest: bytes, refers_to: object, level: int) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32(digest)}",
        *([] if url is None else [f"WARC-Target-URI: {clean(url)}"]),
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {IDENTICAL}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, level: int = 3) -> str:
    """Write the archives to ``path`` and give the path back.

    Payloads of ``min_bytes`` or more are compared. Only ids and digests meet by digest, so a payload with many copies is
    not moved to one place; the rows that become revisits then come to their pages by id.
    """
    rows = small_batches(pages).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    digest = F.unhex(F.sha1("html"))
    known = rows.where((F.octet_length("html") >= min_bytes) & F.col("id").isNotNull()).select("id", digest.alias("digest"))
    first = known.groupBy("digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("largest")).where("refers_to < largest")
    later = known.join(first, "digest").where("id > refers_to").select("id", "digest", "refers_to").distinct()
    tagged = rows.withColumn("digest", digest).join(later, ["id", "digest"], "left")

    def run(batches):
        for b in batches:
            col = {n: b.column(n).to_pylist() for n in b.schema.names}
            out = [record(i, u, h.encode(), d, r, level) for i, u, h, d, r in zip(col["id"], col["url"], col["html"], col["digest"], col["refers_to"])]
            yield pa.record_batch([pa.array(out, type=pa.binary())], names=["value"])

    members = tagged.mapInArrow(lean(run), "value binary")
    # the text writer copies the bytes of a value as they are
    members.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).text(path)
    return path


class Source:
    """Bytes of a file by position, read in blocks."""

    def __init__(self, file: pa.NativeFile, length: int):
        self.file, self.length, self.at, self.held = file, length, 0, b""

    def get(self, start: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``start``."""
        n = min(n, self.length - start)
        if n <= 0:
            return b""
        if not (self.at <= start and start + n <= self.at + len(self.held)):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(max(n, READ))
        return self.held[start - self.at : start - self.at + n]

    def find(self, start: int, stop: int) -> int:
        """The first gzip magic that starts in [start, stop), or -1."""
        while start < stop:
            block = self.get(start, min(READ // 2, stop - start) + len(MAGIC) - 1)
            if (k := block.find(MAGIC)) >= 0 and start + k < stop:
                return start + k
            if len(block) < len(MAGIC):
                return -1
            start += len(block) - len(MAGIC) + 1
        return -1


def member(source: Source, start: int) -> tuple[bytes, int] | None:
    """The bytes of the member that starts here and where it ends; nothing if it is no record or another member does not follow."""
    opened = zlib.decompressobj(31)
    parts, at = [], start
    seen = 0
    try:
        while not opened.eof:
            block = source.get(at, 1 << 16)
            if not block:
                return None
            at += len(block)
            part = opened.decompress(block)
            parts.append(part)
            if seen < 5:
                seen += len(part)
                if not b"WARC/".startswith((head := b"".join(parts)[:5])[:5]) and head:
                    return None
    except zlib.error:
        return None
    end = at - len(opened.unused_data)
    body = b"".join(parts)
    if not body.startswith(b"WARC/") or (end < source.length and source.get(end, 3) != MAGIC):
        return None
    return body, end


def parsed(body: bytes) -> tuple:
    """The fields of a record."""
    head, _, rest = body.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)[1])
    urn = lambda x: x[len("<urn:page:") : -1] or None if x else None
    kind, digest = named["WARC-Type"], named["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        if (len(payload), base32(hashlib.sha1(payload).digest())) != (size, digest):
            raise ValueError(f"record {named['WARC-Record-ID']}: the payload is not the one that its header names")
    uri = named.get("WARC-Target-URI")
    return urn(named["WARC-Record-ID"]), kind, None if uri is None else plain(uri), urn(named.get("WARC-Refers-To")), digest, size, payload if kind == "response" else None


def records(source: Source, start: int, stop: int) -> Iterator[tuple]:
    """The records that start in [start, stop)."""
    while (start := source.find(start, stop)) >= 0:
        found = member(source, start)
        if found is None:
            start += 1  # not the start of a record
        else:
            yield parsed(found[0])
            start = found[1]


def read(spark: SparkSession, path: str, range_bytes: int = RANGE, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of all archives under ``path``: ids, types and digests as strings, payloads of responses in bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(range_bytes))).alias("start"))
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        for b in batches:
            for name, length, start in zip(*(c.to_pylist() for c in b.columns)):
                system, at = pyarrow.fs.FileSystem.from_uri(name)
                with system.open_input_file(at) as file:
                    held, n = [], 0
                    for r in records(Source(file, length), start, min(length, start + range_bytes)):
                        held.append(r)
                        n += 500 + len(r[-1] or b"")
                        if n >= batch_bytes:
                            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held, n = [], 0
                    if held:
                        yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    # a range is a few bytes as a row and much work as a task: one task for each, or for a few of very many
    return ranges.repartition(min(MOST_TASKS, max(1, ranges.count())), "path", "start").mapInArrow(lean(run), FIELDS)
