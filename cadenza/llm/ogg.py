"""Media columns in Ogg: page checksums, lacing, logical streams, granule positions.

``write_ogg`` stores each text's UTF-8 bytes (padded with 255 to a positive multiple of
576) as 8-bit samples in an Ogg file with two multiplexed logical streams: samples and a
short description. ``read_ogg`` verifies every page's checksum, reassembles packets from
the lacing values, separates the streams and derives times from granule positions.

Edge cases: a null or empty text is one packet of 576 padding bytes; a null id is kept;
repeated rows give repeated results; other columns of the input are not read. A file
with a bad checksum, a missing page or a broken packet raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bounded_batches

FRAME = 576  #: bytes (samples) of a packet
RATE = 8000  #: samples per second, written in the header
SAMPLES, NOTES = 0x53414D50, 0x4E4F5445  #: serial numbers of the two streams
MARK = {SAMPLES: b"\x80samples", NOTES: b"\x80notes"}
HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 04c11db7, most significant bit first, no inversion).

    It equals zlib's CRC over bit-reversed bytes, without its inversions, bit-reversed.
    """
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    b = c.to_bytes(4, "little").translate(_REVERSED)
    return int.from_bytes(b, "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    c = checksum(head + body)
    return head[:22] + struct.pack("<I", c) + head[26:] + body


def stream_pages(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """Pages of one logical stream; the first packet has the first page to itself."""
    pages, number = [page(serial, 0, FIRST | (LAST if len(packets) == 1 else 0), granules[0], *_laced(packets[0]))], 1
    lacing, body, granule, flags = bytearray(), bytearray(), -1, 0
    for n, (p, g) in enumerate(zip(packets[1:], granules[1:], strict=True)):
        whole, at = _laced(p)[0], 0
        while at < len(whole):
            take = whole[at : at + 255 - len(lacing)]
            off = 255 * at
            lacing += take
            body += p[off : off + sum(take)]
            at += len(take)
            ended = at == len(whole)
            if ended:
                granule = g
            last = ended and n == len(packets) - 2
            if len(lacing) == 255 or last:
                pages.append(page(serial, number, flags | (LAST if last else 0), granule, bytes(lacing), bytes(body)))
                number, flags, granule = number + 1, 0 if ended else CONTINUED, -1
                lacing, body = bytearray(), bytearray()
    return pages


def _laced(p: bytes) -> tuple[bytes, bytes]:
    return b"\xff" * (len(p) // 255) + bytes([len(p) % 255]), p


def store(payload: bytes, note: bytes) -> bytes:
    """One Ogg file: both streams' first pages come first, then their other pages in turn."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    a = stream_pages(SAMPLES, [MARK[SAMPLES] + struct.pack("<IH", RATE, 8), *frames], [0, *range(FRAME, len(payload) + 1, FRAME)])
    b = stream_pages(NOTES, [MARK[NOTES], note], [0, 0])
    return b"".join([a[0], b[0], a[1], *b[1:], *a[2:]])


def read(media: bytes) -> dict[int, dict]:
    """Logical streams by serial number: packets, granule position of each page's last packet, pages."""
    streams: dict[int, dict] = {}
    at, total = 0, len(media)
    while at < total:
        if total - at < HEAD.size:
            raise ValueError("truncated page header")
        magic, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        start = at + HEAD.size + n
        lacing = np.frombuffer(media, np.uint8, n, at + HEAD.size).astype(np.int64) if total >= start else None
        if lacing is None or start + int(lacing.sum()) > total:
            raise ValueError("truncated page")
        end = start + int(lacing.sum())
        whole = media[at:end]
        if checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            raise ValueError(f"bad checksum of page {number}")
        s = streams.setdefault(serial, {"packets": [], "granule": 0, "pages": 0, "open": b"", "ended": False})
        if number != s["pages"] or bool(flags & FIRST) != (number == 0) or s["ended"]:
            raise ValueError("page missing or out of order")
        if bool(flags & CONTINUED) != bool(s["open"]):
            raise ValueError("packet not continued")
        body, carry = media[start:end], s["open"]
        ends = np.flatnonzero(lacing < 255)
        cut = np.cumsum(lacing)[ends]
        prev = 0
        for c in cut.tolist():
            s["packets"].append(carry + body[prev:c] if carry else body[prev:c])
            carry, prev = b"", c
        s["open"] = carry + body[prev:] if prev < len(body) or carry else b""
        s["pages"] += 1
        s["granule"] = granule if granule >= 0 else s["granule"]
        s["ended"] = bool(flags & LAST)
        at = end
    if any(s["open"] or not s["ended"] for s in streams.values()):
        raise ValueError("stream not ended")
    return streams


def describe(media: bytes) -> tuple[bytes, int, str]:
    """Payload, unpadded length and features of a stored file."""
    by_mark = {s["packets"][0][: len(MARK[k])]: s for s in read(media).values() for k in MARK if s["packets"][0].startswith(MARK[k])}
    a, b = by_mark[MARK[SAMPLES]], by_mark[MARK[NOTES]]
    rate, bits = struct.unpack("<IH", a["packets"][0][len(MARK[SAMPLES]) :])
    payload = b"".join(a["packets"][1:])
    if a["granule"] != len(payload):
        raise ValueError("granule position and samples differ")
    n = int(b["packets"][1])
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    up = x >= 128
    feature = (
        f"streams={len(by_mark)};pages={a['pages'] + b['pages']};packets={len(a['packets']) + len(b['packets'])};bits={bits};"
        f"ms={1000 * a['granule'] // rate};sum={int(x.sum())};energy={int((x * x).sum())};crossings={int((up[1:] != up[:-1]).sum())};peak={int(x.max())}"
    )
    return payload, n, feature


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME), len(raw)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t in b.column(1).to_pylist():
            payload, n = padded(t)
            out.append(store(payload, str(n).encode()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for m in b.column(1).to_pylist():
            payload, n, feature = describe(m)
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", *FACTS])


FACTS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def write_ogg(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): every text as an Ogg file in a binary column."""
    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_write, f"id {kind}, media binary")


def read_ogg(df: DataFrame) -> DataFrame:
    """Sizes, digests and features of the files that ``write_ogg`` made, from their bytes alone."""
    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "media").mapInArrow(_read, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
