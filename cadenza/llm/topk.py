"""Exact top-k inner products with block-at-a-time pruning.

Rows become blocks in the order they are stored: a block holds its rows' forward index
(an integer matrix, rows by id) and for each term (component) the least and greatest
value. A query's bound for a block is the sum over terms of the greatest product. Blocks
are scored in order of falling bounds until the bound is below the k-th best score.

Blocks lie in groups, which have bounds of the same kind. First every query is bounded on every group
and scores the group of its greatest bound; the k-th score there is its threshold. Then it goes,
with its vector, only to groups whose bounds reach the threshold, and within them only blocks that
do are scored. Groups meet queries in chunks of bounded size, both where they are bounded and scored.

Edge cases: vectors that are null or hold null or non-finite components, and rows without
an id, take no part; shorter vectors are filled with zeros; a repeated query id is searched once,
with its smallest vector, and its rows aren't its own candidates; repeated candidates each count; without queries
or candidates the result is empty. Finite components of any size count: integers that
leave 64 bits, components and scores alike, are taken as the nearest that fits, so that
equal ones tie. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import Scratch, lean

BLOCK_ROWS = 512  #: rows of a block
GROUP_BLOCKS = 32  #: blocks that a task scores against a chunk of queries
CHUNK_QUERIES = 4096  #: queries of a chunk
CHUNK_GROUPS = 4096  #: groups that a task bounds for a chunk of queries
SCALE = 1024
#: Sums of products below this are exact in doubles.
EXACT = float(2**53)
INT = np.iinfo(np.int64)


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): components as integers floor(SCALE * x); rows that take no part are gone."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    bad = F.exists("d", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("d")).where("id is not null and d is not null").where(~bad)
    return d.select("id", F.transform("d", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def matrix(rows: list) -> np.ndarray:
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first, n = TaskContext.get().partitionId() << 32, 0
    ids: list[int] = []
    rows: list = []

    def block() -> pa.RecordBatch:
        m = matrix(rows)
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        m, i = m[order], np.array(ids, np.int64)[order]
        cols = [[(first + n) // GROUP_BLOCKS], [i.tobytes()], [m.tobytes()], [m.shape[1]]]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["grp", "ids", "m", "width"])

    for b in batches:
        ids += b.column(0).to_pylist()
        rows += [np.asarray(x.values, np.int64) for x in b.column(1)]
        while len(ids) >= BLOCK_ROWS:
            rest = ids[BLOCK_ROWS:], rows[BLOCK_ROWS:]
            ids, rows = ids[:BLOCK_ROWS], rows[:BLOCK_ROWS]
            yield block()
            n, (ids, rows) = n + 1, rest
    if ids:
        yield block()


def fitting(a: np.ndarray) -> np.ndarray:
    """Python integers as 64-bit ones, those beyond as the nearest."""
    return np.minimum(np.maximum(a, INT.min), INT.max).astype(np.int64)


def small(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether no sum of products of their rows can leave the integers that doubles hold exactly."""
    most = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, b)]
    return 2 * most[0] * most[1] * max(1, a.shape[1]) < EXACT


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly: in doubles where no sum can leave their integers."""
    if small(a, b):
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return fitting(a.astype(object) @ b.astype(object).T)


def bounds_of(q: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Of each query and block, what no row of the block can exceed."""
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    if small(plus, top) and small(minus, low):
        return product(plus, top) + product(minus, low)
    return fitting(plus.astype(object) @ top.astype(object).T + minus.astype(object) @ low.astype(object).T)


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def search(q_ids: np.ndarray, q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query ids, ids, scores) of each query's k best within the blocks, and how many blocks were scored per query in all.

    Scores below ``least``, a threshold of each query, aren't looked for.
    """
    width = max([q.shape[1], *(m.shape[1] for _, m in blocks)])
    q, blocks = widened(q, width), [(i, widened(m, width)) for i, m in blocks]
    top, low = np.array([m.max(0) for _, m in blocks]), np.array([m.min(0) for _, m in blocks])
    bounds = bounds_of(q, top, low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    n = len(q_ids)
    kth = np.full(n, INT.min) if least is None else least.copy()
    best = (np.empty(0, np.int64),) * 3  # query number, id, score
    visited = 0
    for r in range(len(blocks)):
        here = order[:, r]
        alive = np.flatnonzero(bounds[np.arange(n), here] >= kth)
        if not len(alive):
            break
        visited += len(alive)
        found = [best]
        for b in np.unique(here[alive]):
            who = alive[here[alive] == b]
            ids, m = blocks[b]
            s = product(q[who], m)
            i, j = np.nonzero((s >= kth[who][:, None]) & (ids[None, :] != q_ids[who][:, None]))
            found.append((who[i], ids[j], s[i, j]))
        x, ids, s = (np.concatenate(c) for c in zip(*found, strict=True))
        o = np.lexsort((ids, -s, x))
        x, ids, s = x[o], ids[o], s[o]
        place = np.arange(len(x)) - np.searchsorted(x, x, "left")
        keep = place < k
        best = x[keep], ids[keep], s[keep]
        full = place[keep] == k - 1
        kth[best[0][full]] = best[2][full]
    return q_ids[best[0]], best[1], best[2], visited


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, top, low) of each block: greatest and least values by term."""
    for b in batches:
        rows = []
        for g, ids, m, width in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            m = np.frombuffer(m, np.int64).reshape(len(ids) // 8, width)
            rows.append((g, m.max(0).tolist(), m.min(0).tolist()))
        yield pa.RecordBatch.from_pydict({"grp": [r[0] for r in rows], "top": [r[1] for r in rows], "low": [r[2] for r in rows]}, pa.schema([("grp", pa.int64()), ("top", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]))


def _bounds(groups: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """(query_id, grp, bound) of every query and group of two chunks."""
    if not len(groups) or not len(queries):
        return pd.DataFrame({"query_id": [], "grp": [], "bound": []}).astype("int64")
    top, low, q = (matrix(list(x)) for x in (groups["top"], groups["low"], queries["v"]))
    width = max(top.shape[1], q.shape[1])
    top, low, q = (widened(x, width) for x in (top, low, q))
    bound = bounds_of(q, top, low)
    ids, grp = np.meshgrid(queries["id"].to_numpy(np.int64), groups["grp"].to_numpy(np.int64), indexing="ij")
    return pd.DataFrame({"query_id": ids.ravel(), "grp": grp.ravel(), "bound": bound.ravel()})


def _scored(k: int):
    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        held = [(i := np.frombuffer(r.ids, np.int64), np.frombuffer(r.m, np.int64).reshape(len(i), r.width)) for r in a.itertuples()]
        x, y, s, _ = search(b["id"].to_numpy(np.int64), matrix(list(b["v"])), held, k, b["kth"].to_numpy(np.int64))
        return pd.DataFrame({"query_id": x, "vec_id": y, "score": s})

    return score


def top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k best rows of another id, ties to smaller ids."""
    scratch = Scratch(vectors.sparkSession)
    blocks = scratch.stored(quantised(vectors, id_col, vec_col).mapInArrow(lean(_blocks), "grp long, ids binary, m binary, width int"), "topk-blocks")
    q = quantised(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    q = scratch.stored(q, "topk-queries")

    # Extremes of groups: terms that a shorter block lacks are zero there.
    each = blocks.mapInArrow(_extremes, "grp long, top array<long>, low array<long>")
    longer = lambda a, b, f: F.zip_with(a, b, lambda x, y: f(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))
    lists = each.groupBy("grp").agg(F.collect_list("top").alias("t"), F.collect_list("low").alias("l"))  # GROUP_BLOCKS at most
    fold = lambda c, f: F.aggregate(F.slice(c, 2, GROUP_BLOCKS), F.element_at(c, 1), lambda a, b: longer(a, b, f))
    groups = scratch.stored(lists.select("grp", fold("t", F.greatest).alias("top"), fold("l", F.least).alias("low")), "topk-groups")

    chunks, parts = max(1, -(-q.count() // CHUNK_QUERIES)), max(1, -(-groups.count() // CHUNK_GROUPS))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = groups.withColumn("p", of("grp", parts)).withColumn("c", every(chunks))
    right = q.withColumn("chunk", of("id", chunks)).withColumn("part", every(parts))
    bounds = left.groupBy("p", "c").cogroup(right.groupBy("part", "chunk")).applyInPandas(_bounds, "query_id long, grp long, bound long")
    bounds = scratch.stored(bounds, "topk-bounds")  # ids and numbers, no vectors

    def scored(wanted: DataFrame) -> DataFrame:
        """Results of (query_id, grp, kth): each query in the groups that are wanted."""
        asked = wanted.join(q, F.col("query_id") == F.col("id")).select("id", "v", "kth", F.col("grp").alias("g"), of("id", chunks).alias("chunk"))
        held = asked.select(F.col("g").alias("w"), "chunk").distinct()
        here = blocks.join(held, F.col("grp") == F.col("w")).select("grp", F.col("chunk").alias("c"), "ids", "m", "width")
        return here.groupBy("grp", "c").cogroup(asked.groupBy("g", "chunk")).applyInPandas(_scored(k), "query_id long, vec_id long, score long")

    low = F.lit(int(INT.min)).cast("long")
    seed = bounds.groupBy("query_id").agg(F.max(F.struct("bound", "grp")).alias("b")).select("query_id", F.col("b.grp").alias("grp"), low.alias("kth"))
    first = scratch.stored(scored(seed), "topk-first")
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("s"))
    kth = seed.select("query_id", F.col("grp").alias("seed")).join(kth, "query_id", "left").select("query_id", "seed", F.coalesce("s", low).alias("kth"))
    rest = bounds.join(kth, "query_id").where("grp <> seed AND bound >= kth").select("query_id", "grp", "kth")
    some = scratch.stored(first.unionByName(scored(rest)), "topk-scored")
    scratch.drop_but(some)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
