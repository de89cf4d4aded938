"""Interval, nearest and as-of joins of segments with speaker turns, ranges and times.

All are equi joins on (rec_id, cell); see intervals.overlap_join. Nearest joins are
as-of joins in both directions by window, so that no candidate pairs are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators.intervals import overlap_join

HOLD, EPSILON = 0.18, 0.03


def nearest_speaker(cues: DataFrame, turns: DataFrame) -> DataFrame:
    """(rec_id, seg_idx, near): speaker of the turn nearest to each cue's midpoint among those that end before or start after it.

    Of equally near turns the one that starts first, then ends first, then the least name.
    """
    mid = cues.select("rec_id", "seg_idx", ((F.col("start") + F.col("end")) / 2).alias("t"), F.lit(1).alias("cue"))
    ends = turns.groupBy("rec_id", F.col("end").alias("t")).agg(F.min(F.struct("start", "speaker")).alias("first"))
    ends = ends.select("rec_id", "t", F.struct(F.col("t").alias("x"), F.col("first.speaker").alias("speaker")).alias("left"))
    starts = turns.select("rec_id", F.col("start").alias("t"), F.struct(F.col("start").alias("x"), "end", "speaker").alias("right"))
    rows = mid.unionByName(ends, allowMissingColumns=True).unionByName(starts, allowMissingColumns=True)
    w = W.partitionBy("rec_id").orderBy("t")
    before = F.max("left").over(w.rangeBetween(W.unboundedPreceding, W.currentRow))
    after = F.min("right").over(w.rangeBetween(W.currentRow, W.unboundedFollowing))
    rows = rows.withColumn("b", before).withColumn("a", after).where("cue = 1")
    dist = lambda c: F.round(F.abs(F.col("t") - F.col(f"{c}.x")), 9)
    pick = F.when(F.col("a").isNull() | (dist("b") <= dist("a")), F.col("b.speaker")).otherwise(F.col("a.speaker"))
    return rows.select("rec_id", "seg_idx", pick.alias("near"))


def overlap_argmax(cues: DataFrame, turns: DataFrame) -> DataFrame:
    """Each cue's speaker by greatest total overlap (ties: greatest name), else of the nearest turn."""
    keyed = cues.select("rec_id", "seg_idx", "start", "end")
    pairs = overlap_join(keyed, turns.select("rec_id", "start", "end", "speaker"))
    seconds = pairs.groupBy("rec_id", "seg_idx", F.col("r_speaker").alias("s")).agg(F.round(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")), 6).alias("o"))
    best = seconds.groupBy("rec_id", "seg_idx").agg(F.max(F.struct("o", "s")).alias("m"))
    alone = keyed.join(best, ["rec_id", "seg_idx"], "left_anti")
    near = nearest_speaker(alone, turns)
    found = keyed.select("rec_id", "seg_idx").join(best, ["rec_id", "seg_idx"], "left").join(near, ["rec_id", "seg_idx"], "left")
    return found.select("rec_id", "seg_idx", F.coalesce("m.s", "near").alias("speaker"), F.coalesce("m.o", F.lit(0.0)).alias("seconds"))


def overlap_vote(cues: DataFrame, turns: DataFrame, purity: float = 0.45, seconds: float = 1.2, share: float = 0.35) -> DataFrame:
    """Majority speaker where it is pure or long enough, with purity; null where it isn't."""
    keyed = cues.select("rec_id", "seg_idx", "start", "end")
    pairs = overlap_join(keyed, turns.select("rec_id", "start", "end", "speaker"))
    per = pairs.groupBy("rec_id", "seg_idx", "start", "end", F.col("r_speaker").alias("s")).agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("o"))
    top = per.groupBy("rec_id", "seg_idx", "start", "end").agg(F.max(F.struct(F.round("o", 6).alias("o"), "s")).alias("m"), F.round(F.sum("o"), 6).alias("total"))
    pure = F.round(F.col("m.o") / F.col("total"), 6)
    enough = (pure >= purity) | (F.col("m.o") >= F.least(F.lit(seconds), (F.col("end") - F.col("start")) * share))
    return top.select("rec_id", "seg_idx", F.when(enough, F.col("m.s")).alias("speaker"), pure.alias("purity"))


def in_ranges(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows whose midpoint lies in a range (closed); all rows of recordings without any range."""
    mid = points.withColumn("mid", F.round((F.col("start") + F.col("end")) / 2, 6))
    probe = mid.select("rec_id", "seg_idx", F.col("mid").alias("start"), F.col("mid").alias("end"))
    hit = overlap_join(probe, ranges.select("rec_id", "start", "end"), closed=True).select("rec_id", "seg_idx").distinct()
    known = ranges.select("rec_id").distinct()
    inside = points.join(hit, ["rec_id", "seg_idx"], "left_semi")
    return inside.unionByName(points.join(known, "rec_id", "left_anti"))


def asof_segment(times: DataFrame, segments: DataFrame) -> DataFrame:
    """(rec_id, t, seg_idx): the latest segment that has begun, if it is still active at t."""
    begun = segments.select("rec_id", (F.col("start") - EPSILON).alias("at"), F.struct("seg_idx", "end", "text").alias("s"))
    asked = times.select("rec_id", F.col("t").alias("at"), "t")
    w = W.partitionBy("rec_id").orderBy("at", F.col("t").isNotNull())
    rows = begun.unionByName(asked, allowMissingColumns=True).withColumn("s", F.last("s", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    shown = F.regexp_replace("s.text", r"[，。！？；：、,.!?;:\s]", "") != ""
    active = (F.col("t") <= F.col("s.end") + HOLD) & shown
    return rows.where("t IS NOT NULL").select("rec_id", "t", F.when(active, F.col("s.seg_idx")).alias("seg_idx"))


def gold_text(windows: DataFrame, segments: DataFrame, pad: float = 0.0) -> DataFrame:
    """Text of the segments that overlap each padded window (rec_id, win, start, end), in order."""
    wide = windows.select("rec_id", "win", (F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end"))
    pairs = overlap_join(wide, segments.select("rec_id", "start", "end", "seg_idx", "text"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("r_seg_idx", "r_text"))), lambda x: x["r_text"])
    return pairs.groupBy("rec_id", "win").agg(F.array_join(text, "").alias("text"))


def local_reference(windows: DataFrame, segments: DataFrame, seconds: float = 15.0, chars: int = 60) -> DataFrame:
    """Text just before, inside and just after each window, the outer two cut to so many characters."""
    wide = windows.select("rec_id", "win", (F.col("start") - seconds).alias("start"), (F.col("end") + seconds).alias("end"), F.col("start").alias("ws"), F.col("end").alias("we"))
    pairs = overlap_join(wide, segments.select("rec_id", "start", "end", "seg_idx", "text"))
    side = F.expr("CASE WHEN r_end <= ws THEN 'left' WHEN r_start >= we THEN 'right' ELSE 'inner' END")
    said = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("r_seg_idx", "r_text")))), lambda x: x["r_text"]), "")
    out = pairs.withColumn("side", side).groupBy("rec_id", "win").agg(*(said(k).alias(k) for k in ("left", "inner", "right")))
    return out.select("rec_id", "win", F.expr(f"right(`left`, {chars})").alias("left_text"), F.col("inner").alias("text"), F.expr(f"left(`right`, {chars})").alias("right_text"))


def last_window(windows: DataFrame, segments: DataFrame) -> DataFrame:
    """Of the windows that overlap a segment, the last by number."""
    pairs = overlap_join(segments.select("rec_id", "seg_idx", "start", "end"), windows.select("rec_id", "start", "end", "win"))
    return pairs.groupBy("rec_id", "seg_idx").agg(F.max("r_win").alias("win"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows at one position whose speakers differ."""
    b = after.select("rec_id", "seg_idx", F.col("speaker").alias("to_speaker"))
    return before.join(b, ["rec_id", "seg_idx"]).where("NOT (speaker <=> to_speaker)").select("rec_id", "seg_idx", F.col("speaker").alias("from_speaker"), "to_speaker")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows by pair of labels at one position."""
    other = b.select("rec_id", "seg_idx", F.col("speaker").alias("other"))
    return a.join(other, ["rec_id", "seg_idx"]).where("speaker IS NOT NULL AND other IS NOT NULL").groupBy("speaker", "other").agg(F.count("*").alias("n"))
