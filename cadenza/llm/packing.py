"""Best-fit packing of tokenised documents into sequences, by hierarchical residual rounds.

Each task packs the pieces that it reads, best fit by falling length, up to ``UNIT_PIECES`` at a
time, and emits full and nearly full bins. The rest goes up a tree: each round takes the
underfull bins of ``FAN_IN`` units as items, packs them again best fit, emits nearly full ones,
and passes on the rest, until one unit is left. Only bins and their fills travel; members are
joined to their sequences at the end.

How many bins a unit passes on is bounded without loss. Of best-fit bins at most one is half
full or less (two such would share a bin), and only such a bin can join another. So a unit's
bins meet at most ``FAN_IN - 1`` of them in each round, and the ``FAN_IN * rounds`` emptiest
bins of a unit are all that can ever receive one: where a fuller one has room, an
emptier one that is still free has it too. Bins beyond these are emitted as they are.

Edge cases: a null or empty text is the end mark alone; null ids are kept; repeated rows are
documents of their own; a document longer than a sequence is cut into full pieces and a
rest; ties go by order of reading; an empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.bpe import encoded, gathered, words
from cadenza.llm.common import Scratch, bounded_batches, lean

CAPACITY = 4096  #: tokens of a sequence
END_ID = 1  #: closes every document
UNIT_PIECES = 100_000  #: pieces packed at once
FAN_BITS = 3
FAN_IN = 1 << FAN_BITS  #: units that meet in the next round
NEARLY_FULL = CAPACITY - 8  #: bins of this many tokens are emitted at once
MEMO_WORDS = 500_000  #: words whose ids a worker remembers
SLICE_ROWS = 1000  #: texts tokenised at a time

#: Bins of a unit's pieces; rank counts its underfull bins from the emptiest, null for the others.
BINS = "bin long, part long, seq long, fill int, rank int, members array<struct<doc_id:{id},piece:int,start:long,length:int,ids_crc32:long,offset:int>>"
#: Which bin an item went into and where; rank as above, on one item of each bin.
MOVES = "node long, item long, bin long, offset int, fill int, rank int"


class Memo:
    """Ids of words as the tokenizer gives them, kept for the worker's later tasks; when full it forgets the rarer half."""

    def __init__(self, path: str):
        self.path, self.number = path, {}
        self.flat, self.first, self.met = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def shed(self) -> None:
        """Forget all but the words that most slices had."""
        some = list(self.number)
        keep = np.sort(np.argsort(-self.met[: len(some)], kind="stable")[: MEMO_WORDS // 2])
        n = np.diff(self.first[: len(some) + 1])
        ids, at = gathered(self.flat, self.first[: len(some)], n, keep)
        self.number = {some[k]: i for i, k in enumerate(keep.tolist())}
        self.flat, self.first, self.met = ids, at, np.concatenate((self.met[keep] // 2, np.zeros(1, np.int32)))

    def __call__(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, the first id of each word, and how many it has."""
        some = distinct.to_pylist()
        if len(self.number) > MEMO_WORDS:
            self.shed()
        number = self.number
        if new := [w for w in some if w not in number]:
            ids, n = encoded(self.path, new)
            known, end = len(number), int(self.first[len(number)])
            self.flat, self.first, self.met = _room(self.flat, end + len(ids)), _room(self.first, known + len(new) + 1), _room(self.met, known + len(new) + 1)
            self.flat[end : end + len(ids)] = ids
            self.first[known + 1 : known + len(new) + 1] = end + np.cumsum(n)
            self.met[known : known + len(new)] = 0
            number.update(zip(new, range(known, known + len(new)), strict=True))
        code = np.fromiter(map(number.__getitem__, some), np.int64, len(some))
        self.met[code] += 1
        return self.flat, self.first[code], self.first[code + 1] - self.first[code]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate((a, np.zeros(max(n - len(a), len(a)), a.dtype)))


@cache
def memo_of(path: str) -> Memo:
    return Memo(path)


def tokens(texts: pa.Array, memo: Memo) -> Iterator[np.ndarray]:
    """Ids of each text, with the end mark."""
    distinct, code, starts = words(texts)
    ids, at = gathered(*memo(distinct), code)
    cut = at[starts]
    end = np.array([END_ID], ids.dtype)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield np.concatenate((ids[a:b], end))


def best_fit(lengths: Iterable[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers: items by falling length, each into the fullest bin that has room."""
    lengths = np.asarray(list(lengths), np.int64)
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where some bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := rooms >> n:
            room = n + ((fits & -fits).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - n:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def ranks(fills: np.ndarray) -> list[int | None]:
    """Place of each underfull bin among them, the emptiest first, from 0; none for nearly full ones."""
    out: list[int | None] = [None] * len(fills)
    under = np.flatnonzero(fills < NEARLY_FULL)
    for place, j in enumerate(under[np.argsort(fills[under], kind="stable")].tolist()):
        out[j] = place
    return out


def _cut(doc_id, ids: np.ndarray) -> Iterator[tuple]:
    for piece, start in enumerate(range(0, len(ids), CAPACITY)):
        part = ids[start : start + CAPACITY]
        yield doc_id, piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes())


def _unit(part: int, seq: int, pieces: list[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The bins of a unit's pieces."""
    lengths = np.array([p[3] for p in pieces], np.int64)
    bins = best_fit(lengths)
    fills = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "offset")
    members = pa.list_(pa.struct([("doc_id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("offset", pa.int32())]))
    rank = ranks(fills)
    for at in range(0, len(bins), 2000):
        some, held = range(at, min(at + 2000, len(bins))), []
        for j in some:
            ends = np.cumsum(lengths[bins[j]]).tolist()
            held.append([dict(zip(names, (*pieces[i], e - pieces[i][3]), strict=True)) for i, e in zip(bins[j], ends, strict=True)])
        cols = [pa.array([(part << 34) + (seq << 17) + j for j in some], pa.int64()), pa.array([part] * len(some), pa.int64()), pa.array([seq] * len(some), pa.int64())]
        cols += [pa.array(fills[at : at + 2000], pa.int32()), pa.array(rank[at : at + 2000], pa.int32()), pa.array(held, members)]
        yield pa.RecordBatch.from_arrays(cols, ["bin", "part", "seq", "fill", "rank", "members"])


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    """Best fit of a node's underfull bins; a bin keeps the name of its first item."""
    rows = rows.sort_by([("fill", "descending"), ("bin", "ascending")])
    item, fills = rows.column("bin").to_numpy(), rows.column("fill").to_numpy().astype(np.int64)
    bins = best_fit(fills)
    total = np.array([int(fills[b].sum()) for b in bins], np.int64)
    out = []
    for b, n, r in zip(bins, total.tolist(), ranks(total), strict=True):
        at = 0
        for i in b:
            out.append((key[0].as_py(), int(item[i]), int(item[b[0]]), at, n, None if at else r))
            at += int(fills[i])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["node", "item", "bin", "offset", "fill", "rank"])


def _local(path: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, pieces, memo = TaskContext.get().partitionId(), 0, [], memo_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                b = batch.slice(at, SLICE_ROWS)
                for doc_id, ids in zip(b.column(0).to_pylist(), tokens(b.column(1), memo), strict=True):
                    for piece in _cut(doc_id, ids):
                        pieces.append(piece)
                        if len(pieces) == UNIT_PIECES:
                            yield from _unit(part, seq, pieces, id_type)
                            seq, pieces = seq + 1, []
        if pieces:
            yield from _unit(part, seq, pieces, id_type)

    return lean(run)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    from pyspark.sql.pandas.types import to_arrow_type

    scratch = Scratch(spark)
    kind = docs.schema[id_col].dataType
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bins = scratch.stored(d.mapInArrow(_local(path, to_arrow_type(kind)), BINS.format(id=kind.simpleString())), "packed")
    most = bins.agg(F.max("part").alias("part"), F.max("seq").alias("seq")).first()
    bits = (most.part or 0).bit_length(), (most.seq or 0).bit_length()  # units are numbered by part, then seq
    rounds = max(1, -(-sum(bits) // FAN_BITS))
    passed = F.coalesce(F.col("rank") < FAN_IN * rounds, F.lit(False))
    level, moves = bins.where(passed).select((F.col("part") * (1 << bits[1]) + F.col("seq")).alias("node"), "bin", "fill"), []
    for _ in range(rounds):
        up = level.select(F.shiftright("node", FAN_BITS).alias("node"), "bin", "fill")
        moves.append(scratch.stored(up.groupBy("node").applyInArrow(_merge, MOVES), "packed-moves"))
        level = moves[-1].where(passed).select("node", "bin", "fill")
    # Where each passed bin ends up: its moves, one round after the other.
    at = moves[0].select(F.col("item").alias("home"), F.col("bin").alias("sequence_id"), F.col("offset").cast("long").alias("base"))
    for m in moves[1:]:
        m = m.select("item", F.col("bin").alias("next"), F.col("offset").alias("more"))
        at = at.join(m, F.col("sequence_id") == F.col("item"), "left")
        at = at.select("home", F.coalesce("next", "sequence_id").alias("sequence_id"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
    at = scratch.stored(at, "packed-places")
    scratch.drop_but(bins, at)
    stay = bins.where(~passed).select(F.col("bin").alias("sequence_id"), F.lit(0).cast("long").alias("base"), "members")
    moved = bins.where(passed).join(at, F.col("bin") == F.col("home")).select("sequence_id", "base", "members")
    rows = stay.unionByName(moved).select("sequence_id", "base", F.explode("members").alias("m"))
    return rows.select("m.doc_id", "m.piece", "m.start", F.col("m.length").cast("long").alias("length"), "m.ids_crc32", "sequence_id", (F.col("base") + F.col("m.offset")).alias("offset"))
