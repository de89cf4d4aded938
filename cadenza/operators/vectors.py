"""Embeddings: normalisation, centroids, nearest and profile matching.

Vectors stay arrays in the JVM; similarities are folds over zipped arrays. Tables of
centroids or profiles have one row per speaker and are joined by broadcast only when Spark's own size
check allows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.numbers import between, scaled_round

#: Parts that the vectors of a join with profiles are dealt to.
SALTS = 64
#: Vectors of a block whose pairs one task goes through, and pairs that it holds at once.
BLOCK, CELLS = 8192, 1 << 20
#: Cosines in billionths: what makes them positive, one that isn't a number, and the bits of a range that is counted as one.
LOWEST, NO_NUMBER, RANGE = 1 << 31, 1 << 31, 16


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: str) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def centroids(vectors: DataFrame, label: str, vec: str) -> DataFrame:
    """(label, centroid, n): normalised mean of unit vectors, by component."""
    rows = vectors.select(label, F.posexplode(unit(vec)).alias("i", "x"))
    mean = rows.groupBy(label, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    whole = mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m"), F.max("n").alias("n"))
    return whole.select(label, unit("m").alias("centroid"), "n")


def ranked(vectors: DataFrame, key: str, vec: str, profiles: DataFrame, name: str, centroid: str, k: int = 2) -> DataFrame:
    """Each vector's k most similar profiles, with rank and cosine.

    Vectors are dealt out by a salt that every profile has all of: profiles are few against vectors, and Spark
    broadcasts them where their size allows it.
    """
    p = profiles.select(F.col(name).alias("name"), F.col(centroid).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = vectors.select(key, vec, F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt"))
    pairs = salted.join(p, "salt").where(F.size(vec) == F.size("c"))
    s = pairs.select(key, "name", F.round(cosine(vec, "c"), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "name"))
    return s.withColumn("rank", rank).where(F.col("rank") <= k)


def matched(ranks: DataFrame, key: str, accept: float = 0.75, margin: float = 0.04, review: float = 0.70) -> DataFrame:
    """assign, review or reject by the best score and its margin over the second."""
    top = ranks.groupBy(key).agg(F.max(F.when(F.col("rank") == 1, F.struct("score", "name"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    gap = F.round(F.col("a.score") - F.coalesce("b", F.lit(-1.0)), 6)
    says = F.when((F.col("a.score") >= accept) & (gap >= margin), "assign").when(F.col("a.score") >= review, "review").otherwise("reject")
    return top.select(key, F.col("a.name").alias("name"), F.col("a.score").alias("score"), gap.alias("margin"), says.alias("decision"))


def consistency(vectors: DataFrame, label: str, key: str, vec: str) -> DataFrame:
    """Median, tenth percentile and least cosine over the pairs of each label's vectors, of cosines to nine decimals.

    Vectors are dealt to blocks of about ``BLOCK``, and a task has a pair of blocks. All pairs are gone through twice and never are
    rows: at first they are counted by ranges of the cosine, then those in the few ranges that hold a wanted rank by value.
    """
    rows = vectors.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(label).alias("label"), F.col(key).alias("key"), F.col(vec).alias("x"))
    same = rows.groupBy("label", "key").agg(F.count("*").alias("c"))
    total = same.groupBy("label").agg(((F.sum("c") * (F.sum("c") - 1) - F.sum(F.expr("c * (c - 1)"))) / 2).cast("long").alias("pairs")).where("pairs > 0")
    held = rows.where(~F.exists("x", lambda e: e.isNull())).withColumn("d", F.size("x")).where("d > 0")
    blocks = held.groupBy("label", "d").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = held.join(blocks, ["label", "d"]).withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    own = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("p", F.least("b", "o")).withColumn("q", F.greatest("b", "o"))
    by, cols = ["label", "d", "p", "q"], ["label", "d", "p", "q", "b", "key", "x"]
    kind = rows.schema["label"].dataType.simpleString()
    seen = own.select(cols).groupBy(by).applyInArrow(_counted, f"label {kind}, bin long, n long, least long").groupBy("label", "bin").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    w = W.partitionBy("label").orderBy("bin")
    run = seen.select("label", "bin", "least", F.sum("n").over(w).alias("until"), F.sum("n").over(W.partitionBy("label")).alias("m"), "n").withColumn("before", F.col("until") - F.col("n"))
    place = {name: (F.col("m") - 1) * F.lit(share) for name, share in (("median", 0.5), ("p10", 0.1))}
    ranks = {(name, side.__name__): side(x) for name, x in place.items() for side in (F.floor, F.ceil)}
    inside = lambda r: (r >= F.col("before")) & (r < F.col("until"))
    hit = inside(ranks["median", "floor"])
    for r in ranks.values():
        hit = hit | inside(r)
    wanted = run.where(hit).groupBy("label").agg(F.collect_list(F.struct("bin", "before")).alias("bins"), F.max("m").alias("m"))
    some = own.join(wanted.select("label", F.col("bins.bin").alias("bins")), "label").select(*cols, "bins").groupBy(by).applyInArrow(_listed, f"label {kind}, bin long, v long, n long")
    values = some.groupBy("label", "bin", "v").agg(F.sum("n").alias("n")).join(wanted.select("label", "m", F.explode("bins").alias("e")).select("label", "m", "e.*"), ["label", "bin"])
    values = values.withColumn("until", F.col("before") + F.sum("n").over(W.partitionBy("label", "bin").orderBy("v"))).withColumn("before", F.col("until") - F.col("n"))
    number = lambda v: F.when(F.col(v) == NO_NUMBER, float("nan")).otherwise(F.col(v) / 1e9)
    at = values.groupBy("label").agg(F.max("m").alias("m"), *(F.max(F.when(inside(r), number("v"))).alias("_".join(k)) for k, r in ranks.items()))
    at = at.select("label", *(scaled_round(between(F.col(f"{name}_floor"), F.col(f"{name}_ceil"), x - F.floor(x)), 6).alias(name) for name, x in place.items()))
    least = seen.groupBy("label").agg(F.min("least").alias("v")).select("label", scaled_round(number("v"), 6).alias("least"))
    return total.join(at, "label", "left").join(least, "label", "left").select(F.col("label").alias(label), "pairs", "median", "p10", "least")


def _cosines(rows: pa.Table) -> Iterator[np.ndarray]:
    """Of each pair of the two blocks' vectors, or of one block's, the cosine in billionths, stretch by stretch.

    Where a cosine from a product of matrices is so near to the edge of rounding that its order of summing counts, it is
    summed in the order of components.
    """
    d, p, q = (rows.column(c)[0].as_py() for c in ("d", "p", "q"))
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(float)
    key = rows.column("key").to_pandas().to_numpy()
    side = rows.column("b").to_numpy()
    square = np.zeros(len(x))
    for c in range(d):
        square += x[:, c] * x[:, c]
    real = square != 0
    x, key, side = x[real] / np.sqrt(square[real])[:, None], key[real], side[real]
    if p == q:
        o = np.argsort(key, kind="stable")
        x, key = x[o], key[o]
        a = b = x
        ends = np.searchsorted(key, key, "right")  # pairs are of different keys
    else:
        a, b = x[side == p], x[side == q]
    step = max(1, CELLS // max(1, len(b)))
    for at in range(0, len(a), step):
        some = a[at : at + step]
        first = int(ends[at]) if p == q else 0
        rest = b[first:]
        t = (some @ rest.T) * 1e9
        v = np.rint(t)
        i, j = np.nonzero(np.abs(t - v) > 0.5 - 1e-6 * max(d, 100))
        exact = np.zeros(len(i))
        for c in range(d):
            exact += some[i, c] * rest[j, c]
        exact *= 1e9
        whole = np.trunc(exact)
        v[i, j] = whole + np.sign(exact) * (np.abs(exact - whole) >= 0.5)
        v[np.isnan(v)] = NO_NUMBER
        keep = v[np.arange(first, len(b))[None, :] >= ends[at : at + step, None]] if p == q else v.ravel()
        yield keep.astype(np.int64)


def _counted(rows: pa.Table) -> pa.Table:
    n, least = np.zeros(((NO_NUMBER + LOWEST) >> RANGE) + 1, np.int64), NO_NUMBER
    for v in _cosines(rows):
        if len(v):
            least = min(least, int(v.min()))
            n += np.bincount((v + LOWEST) >> RANGE, minlength=len(n))
    at = np.flatnonzero(n)
    return _table(rows, bin=at, n=n[at], least=np.full(len(at), least))


def _listed(rows: pa.Table) -> pa.Table:
    wanted = np.zeros(((NO_NUMBER + LOWEST) >> RANGE) + 1, bool)
    wanted[rows.column("bins")[0].as_py()] = True
    v, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x in _cosines(rows):
        found, times = np.unique(x[wanted[(x + LOWEST) >> RANGE]], return_counts=True)
        v, at = np.unique(np.concatenate((v, found)), return_inverse=True)
        n = np.bincount(at, np.concatenate((n, times)), len(v)).astype(np.int64)
    return _table(rows, bin=(v + LOWEST) >> RANGE, v=v, n=n)


def _table(rows: pa.Table, **columns: np.ndarray) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table({"label": pa.array([rows.column("label")[0].as_py()] * n, rows.schema.field("label").type), **{k: pa.array(x, pa.int64()) for k, x in columns.items()}})


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The least value at which half of the weight is reached."""
    w = W.partitionBy(*by).orderBy(value)
    rows = rows.withColumn("_cum", F.sum(weight).over(w)).withColumn("_all", F.sum(weight).over(W.partitionBy(*by)))
    return rows.groupBy(*by).agg(F.min(F.when(F.col("_cum") >= F.col("_all") / 2 - 1e-9, F.col(value))).alias("median"), F.round(F.sum(weight), 6).alias("weight"), F.count("*").alias("samples"))


def voice_band(pitch: str | Column, confidence: str | Column) -> Column:
    p, c = (F.col(x) if isinstance(x, str) else x for x in (pitch, confidence))
    return F.when(p.isNull() | (c < 0.25), "unknown").when(p < 155, "low").when(p > 185, "high").otherwise("mid")


def voice_profiles(rows: DataFrame) -> DataFrame:
    """Pitch profile per recording and speaker of (rec_id, speaker, dur, pitch, confidence)."""
    rows = rows.where("speaker IS NOT NULL AND pitch IS NOT NULL").withColumn("w", F.greatest(F.lit(0.05), "confidence") * F.greatest(F.lit(0.1), "dur"))
    m = weighted_median(rows, ["rec_id", "speaker"], "pitch", "w")
    sure = F.least(F.lit(1.0), F.col("weight") / 18)
    return m.select("rec_id", "speaker", F.round("median", 1).alias("pitch_hz"), F.round(sure, 3).alias("pitch_confidence"), voice_band(F.col("median"), sure).alias("voice_band"), "samples")


def voice_mix(rows: DataFrame) -> DataFrame:
    """Speakers' confident low and high voiced seconds, whether they are mixed, and the penalty for it."""
    rows = rows.where("speaker IS NOT NULL AND pitch IS NOT NULL AND confidence >= 0.45").withColumn("band", voice_band("pitch", "confidence"))
    rows = rows.where("band IN ('low', 'high')").withColumn("d", F.greatest(F.lit(0.1), "dur"))
    of = lambda b, x: F.coalesce(F.sum(F.when(F.col("band") == b, x)), F.lit(0))
    m = rows.groupBy("rec_id", "speaker").agg(F.round(of("low", F.col("d")), 6).alias("low_s"), F.round(of("high", F.col("d")), 6).alias("high_s"), of("low", 1).alias("low_n"), of("high", 1).alias("high_n"))
    m = m.withColumn("minor_s", F.least("low_s", "high_s")).withColumn("minor_n", F.expr("CASE WHEN high_s >= low_s THEN low_n ELSE high_n END"))
    m = m.withColumn("ratio", F.col("minor_s") / F.greatest(F.lit(0.001), F.col("low_s") + F.col("high_s")))
    m = m.withColumn("mixed", F.expr("low_s + high_s >= 18 AND low_n + high_n >= 6 AND minor_s >= 6 AND minor_n >= 2 AND ratio >= 0.16"))
    m = m.withColumn("severe", F.expr("mixed AND minor_s >= 10 AND ratio >= 0.22"))
    penalty = F.expr("CASE WHEN mixed THEN 4 + least(8, minor_s / 2) + least(4, ratio * 12) + CASE WHEN severe THEN 7 ELSE 0 END ELSE 0 END")
    return m.select("rec_id", "speaker", F.expr("CASE WHEN high_s >= low_s THEN 'high' ELSE 'low' END").alias("dominant_band"), "low_s", "high_s", "low_n", "high_n", F.round("ratio", 6).alias("minority_ratio"), "mixed", "severe", F.round(penalty, 4).alias("penalty"))
