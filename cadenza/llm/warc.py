"""WARC archives: one gzip member per record, read back sequentially.

``with_roles`` decides which page of equal payloads is stored (``response``) and which
refer to it (``revisit``); ``write_warc`` packs records into archives of bounded size, one
gzip member each; ``read_warc`` inflates members step by step, frames records by their
content length and verifies digests. An archive is a row (archive, content); rows of
``spark.read.format("binaryFile")`` work too, under the names path and content.

Edge cases: null html is an empty payload; null url an empty one; page ids may be null
(such a page refers and is referred to like any other, but loses to any number). Rows with
the same id and payload are all of the same type. An empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bounded_batches, stored

#: Payloads below this many bytes are always stored.
MIN_REVISIT = 1000
#: Bytes of records, before compression, after which an archive is closed.
ARCHIVE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is set for rows that revisit another."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    meta = p.where(F.octet_length("html") >= MIN_REVISIT).select("page_id", "digest")
    # One row for each payload that occurs more than once, stored: the join below then has
    # plain exchanges on either side, which adaptive execution splits where a payload is hot.
    kept = meta.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").drop("n")
    kept = stored(kept, "warc-keepers")
    refers = meta.join(kept, "digest").where("page_id is null or page_id < keeper").select(F.col("page_id").alias("k"), F.col("digest").alias("g"), F.col("keeper").alias("refers_to")).distinct()
    # Payloads move by page, so that equal ones spread.
    return p.join(refers, p.page_id.eqNullSafe(refers.k) & (p.digest == refers.g), "left").drop("k", "g")


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A record's bytes before compression."""
    sha = hashlib.sha1(payload).digest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode()}",
    ]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Framed:
    """A sequential reader's buffer over one gzip member at a time."""

    def __init__(self, content: bytes):
        self.content, self.at = memoryview(content), 0

    def members(self) -> Iterator[bytes]:
        """Each record as (header and block), inflated in steps; framing is checked by the caller."""
        while self.at < len(self.content):
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                if self.at >= len(self.content):
                    raise ValueError("truncated member")
                piece = self.content[self.at : self.at + CHUNK]
                parts.append(z.decompress(piece))
                self.at += len(piece) - len(z.unused_data)
            yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; the content length frames the block."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(h["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("content length and record differ")
    return h, rest[:n]


def facts(h: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), digests verified."""
    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    if sha(block) != h["warc-block-digest"]:
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if h["warc-type"] == "response" and (sha(payload) != h["warc-payload-digest"] or length != len(payload)):
        raise ValueError("payload digest differs")
    number = lambda x: int(v) if (v := x[len("<urn:page:") : -1]) else None
    digest = base64.b32decode(h["warc-payload-digest"].partition(":")[2]).hex()
    refers = number(h["warc-refers-to"]) if "warc-refers-to" in h else None
    return number(h["warc-record-id"]), length, digest, h["warc-type"], refers


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, n, size, out = TaskContext.get().partitionId(), 0, 0, []

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{n:05d}.warc.gz"]), pa.array([b"".join(out)], pa.binary())], ["archive", "content"])

    for b in batches:
        for page_id, url, html, refers in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            raw = record(page_id, url, html.encode(), refers)
            out.append(member(raw))
            size += len(raw)
            if size >= ARCHIVE_BYTES:
                yield closed()
                n, size, out = n + 1, 0, []
    if out:
        yield closed()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for b in batches:
        for content in b.column(0):
            rows = [facts(*parse(x)) for x in Framed(content.as_py()).members()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], FACTS)


FACTS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def write_warc(roles: DataFrame) -> DataFrame:
    """(archive, content) of the rows that ``with_roles`` returned; each partition fills its own archives."""
    bounded_batches(roles.sparkSession)
    return roles.select("page_id", "url", "html", "refers_to").mapInArrow(_write, "archive string, content binary")


def read_warc(archives: DataFrame) -> DataFrame:
    """A row per record of every archive; content is read one record at a time."""
    archives.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARCHIVE_BYTES))
    return archives.select("content").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
