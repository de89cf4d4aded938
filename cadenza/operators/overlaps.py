"""Evidence around overlaps and speaker changes: second speakers, and the cues to look at again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators.intervals import overlap_join

#: Least confidence of an overlap, seconds of context, least support, weight of context, shortest piece.
CONFIDENCE, CONTEXT, SUPPORT, CONTEXT_WEIGHT, SHORTEST = 0.55, 12.0, 0.05, 0.35, 0.12
#: Length of an embedded window, and how many cues after a change are looked at within how many seconds.
CUE_SECONDS, LATER_CUES, LATER_SECONDS = 1.5, 2, 1.5


def second_speakers(overlaps: DataFrame, turns: DataFrame, windows: DataFrame) -> DataFrame:
    """Of each piece that an overlap (rec_id, start, end, confidence) shares with a turn, the likeliest second speaker.

    A speaker's score is its share of the windows' seconds in the piece and a part that decays with the distance
    of its nearest turn; turns and windows are (rec_id, start, end, speaker). Ties go to the greater share, context and name.
    Speakers of neither a window in the piece nor a turn in its context can't be supported, so only these are looked up.
    """
    said = turns.where("speaker <> '' AND end > start").select("rec_id", "start", "end", "speaker")
    sure = overlaps.where(F.col("confidence") >= CONFIDENCE).where("end > start").select("rec_id", "start", "end", "confidence")
    met = overlap_join(sure, said)
    pieces = met.select("rec_id", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"), F.col("r_speaker").alias("primary"), "confidence")
    pieces = pieces.where(F.round(F.col("end") - F.col("start"), 9) >= SHORTEST).groupBy("rec_id", "start", "end", "primary").agg(F.max("confidence").alias("confidence"))
    key = ["rec_id", "start", "end", "primary"]
    asked = pieces.select(*key)
    heard = overlap_join(asked, windows.where("end > start").select("rec_id", "start", "end", "speaker"))
    heard = heard.groupBy(*key, F.col("r_speaker").alias("second")).agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("s"))
    share = heard.select(*key, "second", (F.col("s") / F.sum("s").over(W.partitionBy(*key))).alias("share"))
    wide = asked.select("rec_id", (F.col("start") - CONTEXT).alias("start"), (F.col("end") + CONTEXT).alias("end"), F.col("start").alias("ps"), F.col("end").alias("pe"), "primary")
    gap = F.greatest(F.lit(0.0), F.col("r_start") - F.col("pe"), F.col("ps") - F.col("r_end"))
    near = overlap_join(wide, said, closed=True).groupBy("rec_id", F.col("ps").alias("start"), F.col("pe").alias("end"), "primary", F.col("r_speaker").alias("second")).agg(F.min(gap).alias("gap"))
    both = share.join(near, [*key, "second"], "full").where("second <> primary")
    both = both.select(*key, "second", F.round(F.coalesce("share", F.lit(0.0)), 9).alias("share"), F.round(F.coalesce(F.exp(-F.col("gap") / (CONTEXT / 4)), F.lit(0.0)), 9).alias("context"))
    both = both.where(F.greatest("share", "context") >= SUPPORT).withColumn("score", F.round(F.col("share") + CONTEXT_WEIGHT * F.col("context"), 9))
    best = both.groupBy(*key).agg(F.max(F.struct("score", "share", "context", "second")).alias("b"))
    four = lambda c: F.round(f"b.{c}", 4).alias(c)
    return best.join(pieces, key).select(*key, F.col("b.second").alias("second"), F.round("confidence", 4).alias("confidence"), four("share"), four("context"), four("score"))


def near_changes(cues: DataFrame, changes: DataFrame) -> DataFrame:
    """Cues (rec_id, seg_idx) that lie around changes (rec_id, time), with the window of each to embed; null for short ones.

    Around a change are the first cue that holds it, else that whose middle is nearest (the first of equally near ones), its
    two neighbours, and up to two more after them that begin soon after the change. Cues are numbered by seg_idx.
    """
    n = F.row_number().over(W.partitionBy("rec_id").orderBy("seg_idx"))
    placed = cues.select("rec_id", "seg_idx", "start", "end", n.alias("n"))
    asked = changes.select("rec_id", "time").distinct()
    probe = asked.select("rec_id", F.col("time").alias("start"), F.col("time").alias("end"))
    inside = overlap_join(probe, placed.select("rec_id", "start", "end", "n"), closed=True).groupBy("rec_id", F.col("start").alias("time")).agg(F.min("r_n").alias("at"))
    # The nearest middle on either side, by a window over both relations.
    middles = placed.groupBy("rec_id", ((F.col("start") + F.col("end")) / 2).alias("t")).agg(F.min("n").alias("n"))
    rows = middles.select("rec_id", "t", F.struct("t", "n").alias("m")).unionByName(asked.join(inside, ["rec_id", "time"], "left_anti").select("rec_id", F.col("time").alias("t"), "time"), allowMissingColumns=True)
    w = W.partitionBy("rec_id").orderBy("t")
    rows = rows.withColumn("b", F.max("m").over(w.rangeBetween(W.unboundedPreceding, W.currentRow))).withColumn("a", F.min("m").over(w.rangeBetween(W.currentRow, W.unboundedFollowing)))
    to = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.round(F.abs(F.col(f"{c}.t") - F.col("t")), 9).alias("d"), F.col(f"{c}.n").alias("n")))
    nearest = rows.where("time IS NOT NULL").select("rec_id", "time", F.least(to("a"), to("b"))["n"].alias("at")).where("at IS NOT NULL")
    around = inside.unionByName(nearest).select("rec_id", "time", "at", F.explode(F.sequence(F.col("at") - 1, F.col("at") + 1 + LATER_CUES)).alias("n"))
    late = F.round(F.col("start") - F.col("time"), 9) > LATER_SECONDS
    found = around.join(placed, ["rec_id", "n"]).withColumn("far", (F.col("n") > F.col("at") + 1) & late)
    # The cues after the neighbours end with the first that begins too late.
    stop = F.max(F.col("far").cast("int")).over(W.partitionBy("rec_id", "time", "at").orderBy("n"))
    found = found.withColumn("stop", stop).where("stop = 0").select("rec_id", "seg_idx", "start", "end").distinct()
    middle = (F.col("start") + F.col("end")) / 2 - CUE_SECONDS / 2
    begin = F.when(F.round(F.col("end") - F.col("start"), 9) >= CUE_SECONDS, F.greatest("start", F.least(F.col("end") - CUE_SECONDS, middle)))
    return found.select("rec_id", "seg_idx", F.round(begin, 6).alias("win_start"), F.round(begin + CUE_SECONDS, 6).alias("win_end"))
