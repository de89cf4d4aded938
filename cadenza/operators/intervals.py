"""Interval algebra within recordings: (rec_id, start, end), half-open, any overlap allowed.

Range joins are equi joins on (rec_id, cell of CELL seconds), so that a long recording
is joined cell by cell and no join is a nested loop; the cell of the later start
keeps a pair from appearing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = 30.0


def cells(df: DataFrame, start: str, end: str, name: str, cell: float = CELL) -> DataFrame:
    at = F.sequence(F.floor(F.col(start) / cell), F.floor(F.greatest(F.col(start), F.col(end)) / cell))
    return df.withColumn(name, F.explode(at))


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", closed: bool = False, cell: float = CELL) -> DataFrame:
    """Pairs whose intervals overlap; right's columns are prefixed by r_. Left's rows need a key if how is left."""
    r = right.select("rec_id", *(F.col(c).alias(f"r_{c}") for c in right.columns if c != "rec_id"))
    a, b = cells(left, "start", "end", "cell", cell), cells(r, "r_start", "r_end", "cell", cell)
    meet = (F.col("r_start") <= F.col("end")) & (F.col("r_end") >= F.col("start")) if closed else (F.col("r_start") < F.col("end")) & (F.col("r_end") > F.col("start"))
    once = F.floor(F.greatest("start", "r_start") / cell) == F.col("cell")
    pairs = a.join(b, ["rec_id", "cell"]).where(meet & once).drop("cell")
    if how == "inner":
        return pairs
    keys = [c for c in left.columns]
    return left.join(pairs, keys, "left")


def normalized(ranges: DataFrame, collar: float = 0.0, duration: float = 0.0) -> DataFrame:
    """Widened by the collar, clipped to [0, duration], empty ones dropped, touching ones merged."""
    s, e = F.greatest(F.lit(0.0), F.col("start") - collar), F.col("end") + collar
    if duration > 0:
        s, e = F.least(s, F.lit(duration)), F.least(e, F.lit(duration))
    return merged(ranges.select("rec_id", s.alias("start"), e.alias("end")).where("end > start"))


def merged(ranges: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Union of intervals as disjoint ones."""
    w = W.partitionBy("rec_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = ranges.select("rec_id", "start", "end").withColumn("b", F.coalesce((F.col("start") > reach + tolerance).cast("int"), F.lit(1)))
    rows = rows.withColumn("g", F.sum("b").over(w))
    return rows.groupBy("rec_id", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def union_duration(ranges: DataFrame) -> DataFrame:
    return merged(ranges).groupBy("rec_id").agg(F.round(F.sum(F.col("end") - F.col("start")), 6).alias("seconds"))


def subtracted(source: DataFrame, covered: DataFrame) -> DataFrame:
    """What of the source no covered interval holds: edges counted in order, neighbouring pieces merged."""
    edge = lambda df, a, b: df.select("rec_id", F.col("start").alias("t"), F.lit(a).alias("ds"), F.lit(b).alias("dc")).unionByName(df.select("rec_id", F.col("end").alias("t"), F.lit(-a).alias("ds"), F.lit(-b).alias("dc")))
    at = edge(merged(source), 1, 0).unionByName(edge(merged(covered), 0, 1)).groupBy("rec_id", "t").agg(F.sum("ds").alias("ds"), F.sum("dc").alias("dc"))
    w = W.partitionBy("rec_id").orderBy("t")
    pieces = at.select("rec_id", F.col("t").alias("start"), F.lead("t").over(w).alias("end"), F.sum("ds").over(w).alias("s"), F.sum("dc").over(w).alias("c"))
    return merged(pieces.where("s > 0 AND c = 0 AND end > start"))


def speech_coverage(speech: DataFrame, segments: DataFrame, collar: float = 0.5) -> DataFrame:
    """Seconds of speech, covered and uncovered, with the largest, leading and trailing uncovered stretch."""
    said, held = normalized(speech), normalized(segments, collar)
    gaps = subtracted(said, held).withColumn("d", F.col("end") - F.col("start"))
    total = said.groupBy("rec_id").agg(F.count("*").alias("speech_ranges"), F.sum(F.col("end") - F.col("start")).alias("speech"), F.min("start").alias("s0"), F.max("end").alias("s1"))
    lost = gaps.groupBy("rec_id").agg(F.sum("d").alias("lost"), F.max("d").alias("most"), F.min(F.struct("start", "d")).alias("first"), F.max(F.struct("end", "d")).alias("last"))
    m = total.join(lost, "rec_id", "left").withColumn("lost", F.coalesce("lost", F.lit(0.0)))
    edge = lambda x, at: F.when(F.abs(x - F.col(at)) <= 0.001, 1)
    return m.select(
        "rec_id",
        "speech_ranges",
        F.round("speech", 3).alias("speech_duration_s"),
        F.round(F.greatest(F.lit(0.0), F.col("speech") - F.col("lost")), 3).alias("covered_speech_s"),
        F.round("lost", 3).alias("uncovered_speech_s"),
        F.round((F.col("speech") - F.col("lost")) / F.col("speech"), 6).alias("speech_coverage_ratio"),
        F.round(F.coalesce("most", F.lit(0.0)), 3).alias("max_uncovered_speech_s"),
        F.round(F.coalesce(edge(F.col("first.start"), "s0") * F.col("first.d"), F.lit(0.0)), 3).alias("leading_uncovered_speech_s"),
        F.round(F.coalesce(edge(F.col("last.end"), "s1") * F.col("last.d"), F.lit(0.0)), 3).alias("trailing_uncovered_speech_s"),
    )


def overlap_ratio(segments: DataFrame, ranges: DataFrame, risk_ratio: float = 0.08, risk_seconds: float = 0.12, digits: int = 4) -> DataFrame:
    """Share of each segment that the union of the ranges holds, and whether that is a risk."""
    clipped = overlap_join(segments.select("rec_id", "seg_idx", "start", "end"), merged(ranges))
    per = clipped.groupBy("rec_id", "seg_idx").agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("x"))
    rows = segments.select("rec_id", "seg_idx", "start", "end").join(per, ["rec_id", "seg_idx"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    ratio = F.expr("CASE WHEN end > start THEN x / (end - start) ELSE 0 END")
    return rows.select("rec_id", "seg_idx", F.round(F.least(F.lit(1.0), ratio), digits).alias("overlap_ratio"), ((F.col("x") >= risk_seconds - 1e-9) & (ratio >= risk_ratio)).alias("speaker_overlap_risk"))


def multi_active(segments: DataFrame) -> DataFrame:
    """Seconds during which at least two different speakers are active."""
    own = speaker_union(segments)
    edges = own.select("rec_id", F.col("start").alias("t"), F.lit(1).alias("d")).unionByName(own.select("rec_id", F.col("end").alias("t"), F.lit(-1).alias("d")))
    w = W.partitionBy("rec_id").orderBy("t")
    at = edges.groupBy("rec_id", "t").agg(F.sum("d").alias("d")).select("rec_id", "t", F.lead("t").over(w).alias("u"), F.sum("d").over(w).alias("n"))
    return at.groupBy("rec_id").agg(F.round(F.sum(F.expr("CASE WHEN n >= 2 THEN u - t ELSE 0 END")), 6).alias("seconds"))


def speaker_union(segments: DataFrame) -> DataFrame:
    """Each speaker's intervals merged: (rec_id, speaker, start, end)."""
    key = segments.where("speaker IS NOT NULL AND end > start").select(F.struct("rec_id", "speaker").alias("rec_id"), "start", "end")
    return merged(key).select("rec_id.rec_id", "rec_id.speaker", "start", "end")


def active_sets(reference: DataFrame, prediction: DataFrame) -> DataFrame:
    """Elementary intervals with the sets of active speakers (ref, pred) of (rec_id, speaker, start, end) rows."""
    both = speaker_union(reference).withColumn("side", F.lit("ref")).unionByName(speaker_union(prediction).withColumn("side", F.lit("pred")))
    times = both.select("rec_id", F.explode(F.array("start", "end")).alias("t")).distinct()
    w = W.partitionBy("rec_id").orderBy("t")
    pieces = times.select("rec_id", F.col("t").alias("start"), F.lead("t").over(w).alias("end")).where("end - start > 1e-9")
    held = overlap_join(pieces, both)
    named = lambda side: F.array_sort(F.collect_set(F.when(F.col("r_side") == side, F.col("r_speaker"))))
    return held.groupBy("rec_id", "start", "end").agg(named("ref").alias("ref"), named("pred").alias("pred"))


def error_parts(active: DataFrame) -> DataFrame:
    """Reference time, miss, false alarm and the time in which a match is possible, per recording: what needs no mapping."""
    d = F.col("end") - F.col("start")
    r, p = F.size("ref"), F.size("pred")
    total = lambda c: F.round(F.sum(c * d), 6)
    return active.groupBy("rec_id").agg(total(r).alias("reference_s"), total(F.greatest(F.lit(0), r - p)).alias("miss_s"), total(F.greatest(F.lit(0), p - r)).alias("false_alarm_s"), total(F.least(r, p)).alias("matchable_s"))


def pair_seconds(active: DataFrame) -> DataFrame:
    """Seconds in which a predicted and a reference speaker are active together."""
    rows = active.select("rec_id", (F.col("end") - F.col("start")).alias("d"), F.explode("pred").alias("pred"), "ref").withColumn("ref", F.explode("ref"))
    return rows.groupBy("rec_id", "pred", "ref").agg(F.round(F.sum("d"), 6).alias("seconds"))


def hysteresis(frames: DataFrame, onset: float, offset: float, step: float, min_duration: float, min_gap: float) -> DataFrame:
    """Frames (rec_id, frame, score) to intervals: on from onset, off below offset; short ones dropped, near ones merged."""
    w = W.partitionBy("rec_id").orderBy("frame")
    event = F.when(F.col("score") >= onset, 1).when(F.col("score") < offset, 0)
    on = F.coalesce(F.last(event, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    rows = frames.withColumn("on", on)
    rows = rows.withColumn("g", F.sum((F.col("on") != F.coalesce(F.lag("on").over(w), F.lit(0))).cast("int")).over(w)).where("on = 1")
    runs = rows.groupBy("rec_id", "g").agg((F.min("frame") * step).alias("start"), ((F.max("frame") + 1) * step).alias("end"))
    return merged(runs.where(F.col("end") - F.col("start") >= min_duration - 1e-9), min_gap + 1e-9)
