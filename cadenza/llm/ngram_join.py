"""Jaccard self-join of word shingles with PartEnum signatures, and its components.

A document's set holds its distinct shingles (64-bit hashes). Sizes fall into bands of
ratio 4/3, so that linked sets are in the same or in neighbouring bands. Instance j of the scheme
splits the feature domain into cells and serves the sets of bands j-1 and j; a signature is
a cell with the features a set has there. Linked sets differ in at most d = (|x|+|y|)/7
features, so of x's occupied cells all but d agree with y's. Sets with so few occupied
cells that all might differ also sign their empty ones.

Of the subsets of cells that the scheme may enumerate, each set keeps the smallest that
suffices: by one global order, rarest signature first, its first d+1. Any two linked sets have
their rarest common signature among these. So signatures that few passages or templates give
to many documents are kept only by sets that have hardly anything else.

Candidates are verified on whole sets. Equal sets count as one from the start. To connect
large groups without pairing all their members, every member is first tried against the
leaders of its signatures. Then the signatures of one leader, a family, meet in tasks, large
families as pairs of chunks; a task verifies all pairs across different components that share a
signature and pass an exact bound (sizes, parity sketches), but for those that its earlier links
have joined already, and hands on the links that join. The components of the verified links are
those of all links.

The links of each row, where asked for, are counted afterwards: linked sets are in one component,
so every pair of a component's sets whose sizes allow a link is verified there, once. Large
components are cut into chunks and each pair of chunks is a task's work; counts of sets, not
pairs, leave a task.

Edge cases: null and empty texts have an empty set and no link; texts with fewer words than
a shingle are one shingle; a very long text is a set like others; a row with a null id has no
link and a null component; rows that repeat an id each keep their own text's component; an empty
table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import Scratch, bounded_batches, lean, lean_group, with_ids

WORDS = 5  #: words of a shingle
#: Links: 100 * intersection >= 75 * union. Bands, bounds and cells below are for this.
NUMERATOR, DENOMINATOR = 3, 4
FEATURES_PER_CELL = 2.4  #: of the largest sets of a band
BLOCK_BYTES = 6 << 20  #: text whose sets are made at once
BLOCK_ROWS = 60_000
BUCKET_BYTES = 8 << 20  #: text that a bucket of signatures stands for
LEADERS = 2  #: leaders that a set is tried against in a round
ROUNDS = 2  #: rounds of leaders
GROUP = 500  #: sets of a chunk of a family or a component; two chunks meet in a task
GROUP_BYTES = 16 << 20  #: of a chunk's sets
ONE_TASK = 1 << 21  #: links that one task joins to components; more are joined by rounds of joins

_U = np.uint64
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: One entry of a block's shared signatures.
ENTRY = np.dtype([("sig", "<u4"), ("local", "<u2"), ("flag", "u1"), ("count", "<u4")])
NEXT, EMPTY = 1, 2  #: flags: signed for the band above; an empty cell


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def bands(most: int) -> np.ndarray:
    """Largest size of each band, up to one that holds ``most``, and one more."""
    out, low = [], 1
    while True:
        out.append(max(low, low * DENOMINATOR // NUMERATOR))
        if len(out) > 1 and out[-2] >= most:
            return np.array(out, np.int64)
        low = out[-1] + 1


def cells(top: np.ndarray) -> np.ndarray:
    return np.ceil(top / FEATURES_PER_CELL).astype(np.int64) + 2


def sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in rising order, in a row, and each text's first (one more than texts)."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # a cast slice keeps an offset that ascii_lower doesn't heed
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    flat, length = pc.list_flatten(parts), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    owner, some = np.repeat(np.arange(len(parts)), length), pc.not_equal(flat, "")
    code, owner = flat.filter(some).dictionary_encode(), owner[some.to_numpy(zero_copy_only=False)]
    length = np.bincount(owner, minlength=len(parts)) if len(owner) else np.zeros(len(parts), np.int64)
    start = np.concatenate(([0], np.cumsum(length)))
    word = np.array([xxhash.xxh3_64_intdigest(w) for w in code.dictionary.cast(pa.large_binary()).to_pylist()] or [0], np.uint64)
    w = np.concatenate((word[code.indices.to_numpy(zero_copy_only=False)], np.zeros(WORDS, np.uint64))) if len(owner) else np.zeros(WORDS, np.uint64)
    n = len(w) - WORDS
    acc = np.zeros(n, np.uint64)
    for j in range(WORDS):
        acc += w[j : n + j] * _STEP[j]
    h = mixed(acc)
    counts = np.maximum(length - WORDS + 1, (length > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(first[-1], np.uint64)
    for i in range(len(parts)):
        a, b = start[i], start[i + 1]
        if b - a >= WORDS:
            x = h[a : b - WORDS + 1].copy()
            x.sort()
            out[first[i] : first[i + 1]] = x
        elif b > a:
            one = (w[a:b] * _STEP[: b - a]).sum(dtype=np.uint64) + _U(b - a)
            out[first[i]] = mixed(np.array([one], np.uint64))[0]
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[first[:-1][counts > 0]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], kept[first]


def instances(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band of each size, and the cells of every band's instance."""
    tops = bands(int(size.max(initial=1)))
    return np.searchsorted(tops, size), cells(tops)


def signatures(feat: np.ndarray, first: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, flag) of the live sets, and their occupied cells (sets, 2) for own and next instance."""
    size = np.diff(first)
    band, n_cells = instances(size)
    own = np.repeat(np.arange(len(size)), size)
    take = live[own]
    feat, own = feat[take], own[take]
    value = mixed(feat * _STEP[1])
    sigs, sets, flags, occupied = [], [], [], np.zeros((len(size), 2), np.int32)
    for up in (0, 1):
        inst = band + up
        n = n_cells[inst]
        # Features rise within a set, and so do their cells.
        cell = (((feat >> _U(32)) * n[own].astype(np.uint64)) >> _U(32)).astype(np.int64)
        new = np.ones(len(feat), bool)
        new[1:] = (own[1:] != own[:-1]) | (cell[1:] != cell[:-1])
        at = np.flatnonzero(new)
        salt = lambda i, c: i.astype(np.uint64) * _STEP[2] + c.astype(np.uint64) * _STEP[3]
        if len(at):
            who = own[at]
            sigs.append(mixed(np.add.reduceat(value, at) + salt(inst[who], cell[at])))
            sets.append(who)
            flags.append(np.full(len(at), NEXT * up, np.uint8))
            occupied[:, up] = np.bincount(who, minlength=len(size))
        for i in np.flatnonzero(live & (size > 0) & (occupied[:, up] <= size // 3)):
            mine = at[np.searchsorted(own[at], i) : np.searchsorted(own[at], i, "right")]
            void = np.setdiff1d(np.arange(n[i]), cell[mine])
            sigs.append(mixed(salt(np.full(len(void), inst[i]), void) + _U(EMPTY)))
            sets.append(np.full(len(void), i))
            flags.append(np.full(len(void), NEXT * up + EMPTY, np.uint8))
    cat = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
    return cat(sigs, np.uint64), cat(sets, np.int64), cat(flags, np.uint8), occupied


def sketch_bits(size: int) -> int:
    """Bits of a parity sketch, a power of two that is two to four times the size; longer ones fold onto shorter ones."""
    return 1 << max(6, int(size).bit_length() + 1)


def sketch(feat: np.ndarray) -> bytes:
    """Parity of the features that fall on each bit: as many bits differ at most as features do."""
    bits = sketch_bits(len(feat))
    odd = np.bincount((feat & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of sketches in rows (uint8), the longer folded onto the shorter's bits."""
    while a.shape[1] > b.shape[1]:
        a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
    while b.shape[1] > a.shape[1]:
        b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
    x = np.ascontiguousarray(a).view(np.uint64)[:, None, :] ^ np.ascontiguousarray(b).view(np.uint64)[None, :, :]
    return np.bitwise_count(x).sum(2, dtype=np.int32)


FACT = "struct<local:int,doc_id:long,n:int,own:int,above:int,set:binary,signs:boolean,tag:long>"
_FACT = pa.list_(pa.struct([("local", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("own", pa.int32()), ("above", pa.int32()), ("set", pa.binary()), ("signs", pa.bool_()), ("tag", pa.int64())]))
SIGNED = f"bucket int, block long, data binary, facts array<{FACT}>"
_SIGNED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("facts", _FACT)])


def _signed(batch_rows: list[pa.RecordBatch], block: int, buckets: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(batch_rows)
    ids = t.column(0).combine_chunks()
    feat, first = sets_of(t.column(1).cast(pa.large_string()).combine_chunks())
    size = np.diff(first)
    known = np.array(pc.is_valid(ids).to_pylist(), bool)
    keys = [hashlib.blake2b(feat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1], first[1:], strict=True)]
    live, seen = np.zeros(len(size), bool), set()
    for i in np.flatnonzero(known & (size > 0)).tolist():  # of a block's equal sets one signs
        live[i] = keys[i] not in seen
        seen.add(keys[i])
    sig, who, flag, occupied = signatures(feat, first, live)
    bucket = (((sig >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)
    o = np.argsort(bucket, kind="stable")
    e = np.zeros(len(o), ENTRY)
    e["sig"], e["local"], e["flag"] = (sig[o] & _U(0xFFFFFFFF)), who[o], flag[o]
    cut = np.searchsorted(bucket[o], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cut))
    facts = [
        {"local": i, "doc_id": d, "n": int(size[i]), "own": int(occupied[i, 0]), "above": int(occupied[i, 1]), "set": keys[i], "signs": bool(live[i]), "tag": tag}
        for i, (d, tag) in enumerate(zip(ids.to_pylist(), t.column(2).to_pylist(), strict=True))
    ]
    cols = [[*some.tolist(), -1 - block % buckets], [block] * (len(some) + 1), [e[cut[k] : cut[k + 1]].tobytes() for k in some] + [None], [None] * len(some) + [facts]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SIGNED, strict=True)], schema=_SIGNED)


def _sign(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, size, n, held = TaskContext.get().partitionId() << 20, 0, 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                b = batch.slice(at, 100)
                held.append(b)
                n += b.num_rows
                size += pc.sum(pc.binary_length(b.column(1))).as_py() or 0
                if size >= BLOCK_BYTES or n >= BLOCK_ROWS:
                    yield _signed(held, block, buckets)
                    block, size, n, held = block + 1, 0, 0, []
        if held:
            yield _signed(held, block, buckets)

    return run


def _shared(key: tuple, rows: pa.Table) -> pa.Table:
    """Of a bucket: back to each block its entries whose signature may link, with the signature's count."""
    if key[0].as_py() < 0:
        return rows.select(["bucket", "block", "data", "facts"])
    blocks = rows.column("block").to_pylist()
    parts = [np.frombuffer(x, ENTRY) for x in rows.column("data").to_pylist()]
    e = np.concatenate(parts).copy()
    block = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    o = np.argsort(e["sig"], kind="stable")
    e, block = e[o], block[o]
    first = np.flatnonzero(np.concatenate(([True], e["sig"][1:] != e["sig"][:-1])))
    count = np.diff(np.append(first, len(e)))
    # Two sets of one band meet in the instance above it, so a signature needs one set from below.
    below = np.add.reduceat((e["flag"] & NEXT).astype(np.int64), first)
    e["count"] = np.repeat(count, count)
    keep = np.repeat((count > 1) & (below > 0), count)
    e, block = e[keep], block[keep]
    o = np.argsort(block, kind="stable")
    e, cut = e[o], np.searchsorted(block[o], np.arange(len(parts) + 1))
    some = [i for i in range(len(parts)) if cut[i] < cut[i + 1]]
    cols = [[key[0].as_py()] * len(some), [blocks[i] for i in some], [e[cut[i] : cut[i + 1]].tobytes() for i in some], [None] * len(some)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SIGNED, strict=True)], schema=_SIGNED)


def _prefixes(left: pa.Table, right: pa.Table) -> pa.Table:
    """(sig, node) of each set's first d+1 signatures that others share; sets that stand for equal ones elsewhere are left out."""
    facts, parts, buckets, block = None, [], [], None
    for b, k, data, f in zip(*(left.column(c).to_pylist() for c in ("bucket", "block", "data", "facts")), strict=True):
        block = k
        if f is not None:
            facts = f
        else:
            parts.append(np.frombuffer(data, ENTRY))
            buckets.append(b)
    none = pa.table({"sig": pa.array([], pa.int64()), "node": pa.array([], pa.int64())})
    if not parts or facts is None:
        return none
    e = np.concatenate(parts)
    bucket = np.repeat(np.array(buckets, np.int64), [len(x) for x in parts])
    n = max(f["local"] for f in facts) + 1
    size, occupied, out = np.zeros(n, np.int64), np.zeros((2, n), np.int64), np.zeros(n, bool)
    for f in facts:
        size[f["local"]], occupied[0, f["local"]], occupied[1, f["local"]] = f["n"], f["own"], f["above"]
    out[right.column("local").to_numpy()] = True
    up, void, local = (e["flag"] & NEXT).astype(np.int64), (e["flag"] & EMPTY) > 0, e["local"].astype(np.int64)
    o = np.lexsort((e["sig"], bucket, e["count"], void, up, local))
    e, bucket, up, void, local = e[o], bucket[o], up[o], void[o], local[o]
    group = local * 2 + up
    place = np.arange(len(e)) - np.searchsorted(group, group)
    held = np.bincount(group[~void], minlength=2 * n)
    voids = np.bincount(group[void], minlength=2 * n)
    occ = occupied.T.ravel()
    # Unshared signatures come first in the order: occupied ones, then, after all occupied, empty ones.
    _, n_cells = instances(size)
    band, _ = instances(size)
    empties = np.stack([n_cells[band], n_cells[band + 1]], 1).ravel() - occ
    ahead = (occ - held)[group] + np.where(void, (empties - voids)[group], 0)
    keep = (ahead + place < size[local] // 3 + 1) & ~out[local]
    sig = (bucket[keep] << 32) | e["sig"][keep].astype(np.int64)
    return pa.table({"sig": pa.array(sig, pa.int64()), "node": pa.array((block << 16) | local[keep], pa.int64())})


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of the nodes of all links (a, b)."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    ends = np.concatenate([x for x, _ in held] + [y for _, y in held]) if held else np.empty(0, np.int64)
    node, code = np.unique(ends, return_inverse=True)
    a, b = np.split(code, 2)
    up = np.arange(len(node))  # nodes rise, so the least place is the least node
    while len(a):
        low = np.minimum(up[a], up[b])
        np.minimum.at(up, up[a], low)
        np.minimum.at(up, up[b], low)
        while (up[up] != up).any():
            up = up[up]
        apart = up[a] != up[b]
        a, b = a[apart], b[apart]
    for at in range(0, len(node), 1 << 16):
        part = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(node[part], pa.int64()), pa.array(node[up[part]], pa.int64())], ["node", "comp"])


def components(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): the least node that each can reach over links (a, b), which are stored.

    One task joins up to ``ONE_TASK`` of them; with more, labels fall and are shortened until they rest.
    """
    if links.count() <= ONE_TASK:
        found = links.select("a", "b").coalesce(1).mapInArrow(lean(_least), "node long, comp long")
        return scratch.stored(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "labels")
    both = scratch.stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = scratch.stored(nodes.select("node", F.col("node").alias("comp")), "labels")
    while True:
        one = label.select(F.col("node").alias("a"), F.col("comp").alias("la"))
        two = label.select(F.col("node").alias("b"), F.col("comp").alias("lb"))
        seen = both.join(one, "a").join(two, "b").where("lb < la")
        lower = seen.select(F.col("a").alias("node"), "lb").unionByName(seen.select(F.col("la").alias("node"), "lb"))
        lower = lower.groupBy("node").agg(F.min("lb").alias("lb"))
        hooked = scratch.stored(label.join(lower, "node", "left").select("node", F.least("comp", "lb").alias("comp"), F.col("lb").isNotNull().alias("moved")), "labels")
        if not hooked.where("moved").limit(1).count():
            scratch.drop(both, hooked)
            return label
        root = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        scratch.drop(label)
        label = scratch.stored(hooked.join(root, "comp").select("node", F.col("root").alias("comp")), "labels")
        scratch.drop(hooked)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, feat) of (node, set, text) rows whose text has that set."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            b = batch.slice(at, 200)
            feat, first = sets_of(b.column(2))
            raw = [feat[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
            rows = [(n, r) for n, s, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw, strict=True) if hashlib.blake2b(r, digest_size=16).digest() == s]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.binary())], ["node", "feat"])


def _links(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sets, in rising order, link."""
    both = np.sort(np.concatenate((p, q)), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return DENOMINATOR * common >= NUMERATOR * (len(p) + len(q) - common)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs among (a, b, fa, fb) that link, on whole sets."""
    for batch in batches:
        x, y = (batch.column(i).to_pylist() for i in (2, 3))
        ok = [_links(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


class Roots:
    """Components that links join."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def of(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return int(i)

    def all(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up


def _joins(members: list[np.ndarray], left: np.ndarray, comp: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join components, among sets that share a signature.

    ``members`` has the sets of each signature and ``left`` marks those of the first chunk; unless all are of
    it, pairs are between it and the others.
    """
    size, inside = np.array([len(x) for x in sets]), bool(left.all())
    bits = [np.frombuffer(sketch(x), np.uint8) for x in sets]
    width, roots, found, seen = np.array([len(x) for x in bits]), Roots(int(comp.max(initial=-1)) + 1), [], set()
    for i in members:
        if (same := i.tobytes()) in seen:  # signatures of one family tend to have the same members
            continue
        seen.add(same)
        own, other = (i, i) if inside else (i[left[i]], i[~left[i]])
        for wl in np.unique(width[own]).tolist():  # sketches of one length at a time
            for wr in np.unique(width[other]).tolist():
                a, b = own[width[own] == wl], other[width[other] == wr]
                mb = np.stack([bits[k] for k in b])
                for part in range(0, len(a), 128):
                    p, root = a[part : part + 128], roots.all()
                    pair = root[comp[p]][:, None] != root[comp[b]][None, :]
                    if inside:
                        pair &= p[:, None] < b[None, :]
                    na, nb = size[p][:, None], size[b][None, :]
                    pair &= DENOMINATOR * np.minimum(na, nb) >= NUMERATOR * np.maximum(na, nb)
                    if not pair.any():
                        continue
                    pair &= sketch_gap(np.stack([bits[k] for k in p]), mb) * 7 <= na + nb
                    for x, y in zip(*(k.tolist() for k in np.nonzero(pair)), strict=True):
                        x, y = int(p[x]), int(b[y])
                        r, t = roots.of(comp[x]), roots.of(comp[y])
                        if r != t and _links(sets[x], sets[y]):
                            roots.up[max(r, t)] = min(r, t)
                            found.append((x, y))
    return found


def _pairs(rows: pa.Table) -> pa.Table:
    """Links (a, b) that join components within a part's families."""
    col = {c: rows.column(c).to_numpy() for c in ("lead", "lo", "hi", "chunk", "node", "comp")}
    sigs, raw = rows.column("sigs").combine_chunks(), rows.column("feat").to_pylist()
    at, flat = np.concatenate(([0], np.cumsum(pc.list_value_length(sigs).to_numpy(zero_copy_only=False)))).astype(np.int64), pc.list_flatten(sigs).to_numpy(zero_copy_only=False)
    o = np.lexsort((col["node"], col["hi"], col["lo"], col["lead"]))
    key = np.stack([col[c][o] for c in ("lead", "lo", "hi")], 1)
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1)))) if len(o) else np.empty(0, int)
    found = []
    for s, t in zip(first.tolist(), [*first[1:].tolist(), len(o)], strict=True):
        i = o[s:t]
        left = col["chunk"][i] == col["lo"][i[0]]
        if col["lo"][i[0]] != col["hi"][i[0]] and left.all():
            continue
        _, comp = np.unique(col["comp"][i], return_inverse=True)
        sig, who = np.concatenate([flat[at[k] : at[k + 1]] for k in i]), np.repeat(np.arange(len(i)), at[i + 1] - at[i])
        by = np.argsort(sig, kind="stable")
        members = np.split(who[by], np.flatnonzero(sig[by][1:] != sig[by][:-1]) + 1)
        sets = [np.frombuffer(raw[k], np.uint64) for k in i]
        found += [(int(col["node"][i[x]]), int(col["node"][i[y]])) for x, y in _joins([m for m in members if len(m) > 1], left, comp, sets)]
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def chunked(rows: DataFrame, group: str, parts: int) -> DataFrame:
    """``rows`` (group, node, n, ...) with chunk, lo, hi and part: two chunks of a group's nodes meet as (lo, hi) in a part, each pair of chunks once."""
    size = rows.groupBy(group).agg(F.count("*").alias("m"), (F.sum("n") * 8).alias("bytes")).where("m > 1")
    chunks = F.greatest(F.lit(1.0), F.col("m") / GROUP, F.col("bytes") / GROUP_BYTES)
    size = size.select(group, F.pow(F.lit(2), F.ceil(F.log2(chunks))).cast("int").alias("q"))
    rows = rows.join(size, group).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("q")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    rows = rows.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).drop("other", "q")
    return rows.withColumn("part", F.pmod(F.xxhash64(group, "lo", "hi"), F.lit(parts)).cast("int"))


def _degrees(rows: pa.Table) -> pa.Table:
    """(node, linked): the rows, as copies of linked sets, that each set has among a part's pairs of chunks."""
    col = {c: rows.column(c).to_numpy() for c in ("comp", "lo", "hi", "chunk", "node", "n", "w")}
    raw = rows.column("feat").to_pylist()
    linked = np.zeros(len(raw), np.int64)
    o = np.lexsort((col["n"], col["chunk"], col["hi"], col["lo"], col["comp"]))  # by size within a chunk
    key = np.stack([col[c][o] for c in ("comp", "lo", "hi")], 1)
    start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
    for s, t in zip(start.tolist(), [*start[1:].tolist(), len(o)], strict=True):
        i = o[s:t]
        lo, hi = col["lo"][i[0]], col["hi"][i[0]]
        size = col["n"][i].astype(np.int64)
        first = np.concatenate(([0], np.cumsum(size)))
        _, code = np.unique(np.frombuffer(b"".join(raw[k] for k in i), np.uint64), return_inverse=True)
        mark = np.zeros(code.max() + 1, bool)
        own, other = np.flatnonzero(col["chunk"][i] == lo), np.flatnonzero(col["chunk"][i] == hi)
        if not len(other):
            continue
        sizes = size[other]
        for a in own.tolist():
            # The other chunk's sets of a size that may link: they are in a row.
            x = a + 1 if lo == hi else other[0] + np.searchsorted(DENOMINATOR * sizes, NUMERATOR * size[a])
            y = other[0] + np.searchsorted(NUMERATOR * sizes, DENOMINATOR * size[a], "right")
            if x >= y:
                continue
            mine = code[first[a] : first[a + 1]]
            mark[mine] = True
            common = np.add.reduceat(mark[code[first[x] : first[y]]], first[x:y] - first[x], dtype=np.int64)
            mark[mine] = False
            b = i[x:y][DENOMINATOR * common >= NUMERATOR * (size[a] + size[x:y] - common)]
            linked[i[a]] += col["w"][b].sum()
            linked[b] += col["w"][i[a]]
    return pa.table({"node": pa.array(col["node"], pa.int64()), "linked": pa.array(linked, pa.int64())})


def degrees(label: DataFrame, feats: DataFrame, weight: DataFrame, parts: int) -> DataFrame:
    """(node, linked): of each set (node, comp) with features, the rows whose different set links to it; weight is (node, n, w)."""
    rows = chunked(label.join(weight, "node"), "comp", parts).join(feats, "node")
    found = rows.groupBy("part").applyInArrow(lean_group(_degrees), "node long, linked long")
    return found.groupBy("node").agg(F.sum("linked").alias("linked"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_links: bool = False, tag_col: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies) of every row; n_copies counts the rows of equal set.

    With ``with_links`` also n_links, the other rows that link to it, copies among them. With ``tag_col``, a
    column of 64-bit integers, also tag, its value, and group_id, which tells components apart
    even where rows that repeat an id give several the same least id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    stored = scratch.stored
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(tag_col).alias("tag") if tag_col else F.lit(None).cast("long").alias("tag"))
    total = d.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    back = stored(d.mapInArrow(lean(_sign(buckets)), SIGNED).groupBy("bucket").applyInArrow(lean_group(_shared), SIGNED), "jaccard-shared")
    fact = back.where("facts is not null").select("block", F.explode("facts").alias("f")).select("block", "f.*")
    fact = stored(fact.withColumn("node", F.col("block") * 65536 + F.col("local")), "jaccard-facts")

    # Equal sets: one node stands for all; blocks hear which of theirs don't.
    equal = stored(fact.where("doc_id is not null and n > 0").groupBy("set").agg(F.min("node").alias("rep"), F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies")), "jaccard-sets")
    spare = fact.where("signs").select("block", "local", "node", "set").join(equal.select("set", "rep"), "set").where("node != rep")
    spare = spare.select(F.col("block").alias("home"), "local")
    kept = back.groupBy("block").cogroup(spare.groupBy("home")).applyInArrow(lean_group(_prefixes), "sig long, node long")
    kept = stored(kept, "jaccard-kept")
    scratch.drop(back)
    again = stored(kept.groupBy("sig").agg(F.count("*").alias("m")).where("m > 1"), "jaccard-sigs")
    shared = stored(kept.join(again, "sig"), "jaccard-shares")  # (sig, node, m)
    scratch.drop(kept, again)

    # Sets of all that may link, from their texts.
    who = shared.select("node").distinct()
    who = stored(who.join(fact.where("signs").select("node", "doc_id", "set", "n"), "node"), "jaccard-nodes")
    wanted = who.select(F.col("doc_id").alias("k"), "node", "set")
    found = who.count()
    texts = with_ids(d, "doc_id", wanted.select("k"), found).join(wanted, F.col("doc_id") == F.col("k")).select("node", "set", "text")
    feats = stored(texts.mapInArrow(lean(_features), "node long, feat binary").dropDuplicates(["node"]), "jaccard-features")
    if feats.count() != found:
        raise RuntimeError("the table changed between two passes")

    def verified(pairs: DataFrame) -> DataFrame:
        fa, fb = feats.select(F.col("node").alias("a"), F.col("feat").alias("fa")), feats.select(F.col("node").alias("b"), F.col("feat").alias("fb"))
        return pairs.select("a", "b").join(fa, "a").join(fb, "b").select("a", "b", "fa", "fb").mapInArrow(lean(_linked), "a long, b long")

    links, label = [], stored(who.select("node", F.col("node").alias("comp")), "labels")
    for r in range(ROUNDS + 1):
        open_ = shared.join(label, "node").select("sig", "node", "comp")
        mixed_ = open_.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min_by("node", F.xxhash64("node", F.lit(r)) if r else F.col("node")).alias("lead")).where("c0 < c1")
        mixed_ = stored(mixed_.select("sig", "lead"), "jaccard-open")
        if not mixed_.limit(1).count():
            break
        if r < ROUNDS:
            lead = label.select(F.col("node").alias("lead"), F.col("comp").alias("lead_comp"))
            tried = open_.join(mixed_, "sig").where("node != lead").groupBy("node", "lead").agg(F.count("*").alias("n"), F.min("comp").alias("comp"))
            tried = tried.join(lead, "lead").where("comp != lead_comp")
            best = tried.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "lead")), False), 1, LEADERS).alias("x"))
            found = verified(best.select(F.col("node").alias("a"), F.explode("x").alias("x")).select("a", F.col("x.lead").alias("b")))
        else:
            rows = open_.join(mixed_, "sig").groupBy("lead", "node").agg(F.min("comp").alias("comp"), F.collect_list("sig").alias("sigs"))
            rows = stored(rows.join(who.select("node", "n"), "node"), "jaccard-families")
            found = chunked(rows, "lead", buckets * 4).join(feats, "node").groupBy("part").applyInArrow(lean_group(_pairs), "a long, b long")
        links.append(stored(found, "jaccard-links"))
        every = links[0]
        for x in links[1:]:
            every = every.unionByName(x)
        scratch.drop(label, mixed_)
        label = components(who, every, scratch)

    # From nodes to sets to rows.
    comp = label.join(equal.select(F.col("rep").alias("node"), "first_id"), "node")
    least = stored(comp.groupBy("comp").agg(F.min("first_id").alias("component")), "jaccard-components")
    named = stored(label.join(least, "comp").select(F.col("node").alias("rep"), "comp", "component"), "jaccard-named")
    sets = equal.join(named, "rep", "left")
    more = []
    if with_links:
        weight = who.select("node", "n").join(equal.select(F.col("rep").alias("node"), F.col("n_copies").alias("w")), "node")
        linked = stored(degrees(label, feats, weight, buckets * 4), "jaccard-degrees")
        sets = sets.join(linked.withColumnRenamed("node", "rep"), "rep", "left").withColumn("n_links", F.col("n_copies") - 1 + F.coalesce("linked", F.lit(0)))
        more = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    sets = stored(sets.select("set", F.coalesce("comp", "rep").alias("comp"), F.coalesce("component", "first_id").alias("component"), "n_copies", *["n_links"] * with_links), "jaccard-final")
    scratch.drop_but(fact, sets)
    # Empty sets and null ids have no partner: their key is their own.
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("set")).otherwise(F.concat(F.lit("-").cast("binary"), F.col("node").cast("string").cast("binary")))
    if tag_col:
        more += ["tag", F.coalesce("comp", "node").alias("group_id")]
    rows = fact.select("doc_id", "n", "node", "tag", own.alias("set")).join(sets, "set", "left")
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), *more)
