"""BPE encoding and decoding through a table of distinct words.

Texts are split at ASCII blanks, which no token of the tokenizer spans, into words. Rows go
in blocks of ``BLOCK_BYTES``: each block gives its distinct words once, dealt by hash over
buckets; a bucket encodes each distinct word of all blocks once, with the tokenizers
library, and sends ids back to the blocks, which join them to their texts by position.
Decoding looks ids up in the table of pieces, which the vocabulary bounds.

A block's words and its texts are read in two passes over ``docs``, which must be a stored table
(the same rows in the same order each time); a checksum of each block's words is carried along
and a difference raises ``RuntimeError``.

Edge cases: a null text is empty: no ids, empty decoded text; null ids are kept; repeated rows
repeat; a text of one very long word is one word. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bounded_batches, lean, lean_group

BLOCK_BYTES = 12 << 20  #: text of a block, in UTF-8
BUCKET_BYTES = 24 << 20  #: text that a bucket of words stands for
ENCODE_WORDS = 4000  #: words that the library encodes at a time
RUN_WORDS = 200_000  #: words joined to their ids at a time


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def pieces(path: str) -> np.ndarray:
    """The table of pieces: the string of each id, by position."""
    t = tokenizer(path)
    return np.array([t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))], object)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in turn, and each text's first word (one more than texts)."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    flat = pc.list_flatten(parts)
    owner = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    some = pc.not_equal(flat, "")
    code = flat.filter(some).dictionary_encode()
    owner = owner[some.to_numpy(zero_copy_only=False)]
    return code.dictionary, code.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(owner, np.arange(len(parts) + 1))


def encoded(path: str, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words in a row, and how many each has."""
    t, ids, n = tokenizer(path), [], []
    for at in range(0, len(some), ENCODE_WORDS):
        found = [e.ids for e in t.encode_batch_fast(some[at : at + ENCODE_WORDS], add_special_tokens=False)]
        k = np.fromiter(map(len, found), np.int64, len(found))
        ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(k.sum())))
        n.append(k)
    return np.concatenate(ids) if ids else np.empty(0, np.uint32), np.concatenate(n) if n else np.empty(0, np.int64)


def gathered(flat: np.ndarray, first: np.ndarray, n: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words by number, in a row, and the first id of each word (one more than words)."""
    k = n[code]
    at = np.concatenate(([0], np.cumsum(k)))
    return flat[np.repeat(first[code] - at[:-1], k) + np.arange(at[-1])], at


def joined(texts: pa.Array, look) -> Iterator[tuple[int, np.ndarray]]:
    """(number, ids) of each text; look gives ids, firsts and counts of the distinct words. Goes by runs of bounded length."""
    distinct, code, starts = words(texts)
    flat, first, n = look(distinct)
    t, total = 0, len(texts)
    while t < total:
        u = max(t + 1, int(np.searchsorted(starts, starts[t] + RUN_WORDS, "right")) - 1)
        ids, at = gathered(flat, first, n, code[starts[t] : starts[u]])
        cut = at[starts[t : u + 1] - starts[t]]
        for i in range(t, u):
            yield i, ids[cut[i - t] : cut[i - t + 1]]
        t = u


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """(block, ids, texts): rows in order of reading, cut after BLOCK_BYTES."""
    from pyspark import TaskContext

    block, size, held = TaskContext.get().partitionId() << 24, 0, []
    for batch in batches:
        for at in range(0, batch.num_rows, 100):  # batches may be large
            b = batch.slice(at, 100)
            held.append(b)
            size += pc.sum(pc.binary_length(b.column(1))).as_py() or 0
            if size >= BLOCK_BYTES:
                t = pa.Table.from_batches(held).combine_chunks()
                yield block, t.column(0).combine_chunks(), t.column(1).cast(pa.large_string()).combine_chunks()
                block, size, held = block + 1, 0, []
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield block, t.column(0).combine_chunks(), t.column(1).cast(pa.large_string()).combine_chunks()


def _dealt(distinct: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the words by bucket, and the first of each bucket (one more than buckets)."""
    b = np.fromiter((zlib.crc32(w) % buckets for w in distinct.cast(pa.large_binary()).to_pylist()), np.int64, len(distinct))
    o = np.argsort(b, kind="stable")
    return o, np.searchsorted(b[o], np.arange(buckets + 1))


def packed(raw: bytes | pa.Buffer) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpacked(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _sum(distinct: pa.Array) -> int:
    return zlib.crc32("\n".join(distinct.to_pylist()).encode())


def encode_texts(docs: DataFrame, path: str, id_col: str, text_col: str, each, schema: str) -> DataFrame:
    """For every row, ``each(id values, [(number, ids), ...], pieces)`` per block gives the columns of ``schema``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = d.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    kind = "<u2" if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in _blocks(batches):
            distinct, _, _ = words(texts)
            o, first = _dealt(distinct, buckets)
            given = distinct.take(pa.array(o))
            for k in range(buckets):
                if first[k] < first[k + 1]:
                    part = given.slice(first[k], first[k + 1] - first[k]).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int64()), pa.array([packed("\n".join(part).encode())], pa.binary())], ["bucket", "block", "words"])

    def encode(rows: pa.Table) -> pa.Table:
        blocks, buckets_ = rows.column(1).to_pylist(), rows.column(0).to_pylist()
        lists = [pa.array(unpacked(w.as_py()).decode().split("\n"), pa.large_string()) for w in rows.column(2)]
        held = list(zip(buckets_, blocks, map(len, lists), strict=True))
        every = pa.concat_arrays(lists).dictionary_encode()
        del lists
        flat, n = encoded(path, every.dictionary.to_pylist())  # each distinct word once
        first = np.concatenate(([0], np.cumsum(n)))
        code, at, out = every.indices.to_numpy(zero_copy_only=False).astype(np.int64), 0, []
        for k, b, m in held:
            c = code[at : at + m]
            at += m
            ids, _ = gathered(flat, first, n, c)
            out.append((b, k, packed(ids.astype(kind).tobytes()), packed(n[c].astype("<u4").tobytes())))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "bucket", "ids", "n"])

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in _blocks(batches):
            distinct, _, _ = words(texts)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", ids.type), ("text", texts.type)])) as out:
                out.write_batch(pa.RecordBatch.from_arrays([ids, texts], ["id", "text"]))
            cols = [pa.array([block], pa.int64()), pa.array([_sum(distinct)], pa.int64()), pa.array([packed(sink.getvalue())], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["block2", "crc", "rows"])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        sent, out = {k: (i, c) for k, i, c in zip(*(right.column(j).to_pylist() for j in (1, 2, 3)), strict=True)}, []
        for r in left.to_batches():
            for crc, rows in zip(r.column(1).to_pylist(), r.column(2).to_pylist(), strict=True):
                batch = pa.ipc.open_stream(unpacked(rows)).read_all().combine_chunks()
                ids = batch.column(0).combine_chunks() if batch.column(0).num_chunks != 1 else batch.column(0).chunk(0)
                texts = batch.column(1).chunk(0) if batch.column(1).num_chunks == 1 else batch.column(1).combine_chunks()

                def look(distinct: pa.Array, crc=crc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                    if _sum(distinct) != crc:
                        raise RuntimeError("the table changed between two passes")
                    o, first = _dealt(distinct, buckets)
                    n, flat = np.zeros(len(distinct), np.int64), []
                    for k in range(buckets):
                        if first[k] < first[k + 1]:
                            got = np.frombuffer(unpacked(sent[k][1]), "<u4")
                            if len(got) != first[k + 1] - first[k]:
                                raise RuntimeError("the table changed between two passes")
                            n[o[first[k] : first[k + 1]]] = got
                            flat.append(np.frombuffer(unpacked(sent[k][0]), kind).astype(np.uint32))
                    order = np.concatenate(([0], np.cumsum(n[o])))[:-1]
                    at = np.empty(len(o), np.int64)
                    at[o] = order
                    return (np.concatenate(flat) if flat else np.empty(0, np.uint32)), at, n

                out += each(ids, joined(texts, look), pieces(path))
        return pa.Table.from_batches(out)

    parts = d.mapInArrow(lean(split), "bucket int, block long, words binary").groupBy("bucket").applyInArrow(lean_group(encode), "block long, bucket int, ids binary, n binary")
    texts = d.mapInArrow(lean(texts_of), "block2 long, crc long, rows binary")
    return texts.groupBy("block2").cogroup(parts.groupBy("block")).applyInArrow(lean_group(join), schema)


def decoded(ids: np.ndarray, table: np.ndarray) -> str:
    """The pieces of the ids, joined as the tokenizer's decoder (none: by blanks) joins them."""
    return " ".join(table[ids].tolist())


def _digests(ids: pa.Array, found: Iterator[tuple[int, np.ndarray]], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = [(len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded(x, table).encode()).hexdigest()) for _, x in found]
    n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(ids: pa.Array, found: Iterator[tuple[int, np.ndarray]], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([ids, pa.array([x.astype(np.int32) for _, x in found], pa.list_(pa.int32()))], ["id", "ids"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row."""
    return encode_texts(docs, path, id_col, text_col, _ids, f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(id, text) from (id, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decoded(np.asarray(x.values), table) if x.is_valid else "" for x in b.column(1)], pa.string())], ["id", "text"])

    return rows.select("id", "ids").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return encode_texts(docs, path, id_col, text_col, _digests, schema)
