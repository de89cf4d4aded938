"""Runs, turns and neighbours over ordered segments (rec_id, seg_idx, start, end, text, speaker).

Everything is windows over (rec_id) and aggregates: one shuffle by recording serves a
whole chain of them, as Spark keeps the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

def order() -> WindowSpec:
    return W.partitionBy("rec_id").orderBy("seg_idx")
FILLER = r"^[嗯啊呃哦对是好可以行的了哈\s,，。.!！?？]+$"


def labelled(segments: DataFrame) -> DataFrame:
    return segments.where("speaker IS NOT NULL AND speaker <> ''")


def with_runs(segments: DataFrame, max_gap: float | None) -> DataFrame:
    """Labelled rows with run_idx: a run ends where the speaker changes or the gap is over max_gap."""
    w = order()
    broken = F.lag("speaker").over(w).isNull() | (F.col("speaker") != F.lag("speaker").over(w))
    if max_gap is not None:
        broken = broken | (F.col("start") - F.lag("end").over(w) > max_gap)
    rows = labelled(segments).withColumn("broken", broken.cast("int"))
    return rows.withColumn("run_idx", F.sum("broken").over(w)).drop("broken")


def runs(segments: DataFrame, max_gap: float | None = 1.5) -> DataFrame:
    """One row per run; its end is its last row's end."""
    by = with_runs(segments, max_gap).groupBy("rec_id", "run_idx")
    return by.agg(
        F.first("speaker").alias("speaker"),
        F.min("start").alias("start"),
        F.max_by("end", "seg_idx").alias("end"),
        F.count("*").alias("segments"),
        F.min("seg_idx").alias("first_idx"),
        F.max("seg_idx").alias("last_idx"),
    )


def sandwiched(segments: DataFrame) -> Column:
    """Neighbours in the list (labelled or not) agree on another speaker. For rows with order()'s columns."""
    before, after = F.lag("speaker").over(order()), F.lead("speaker").over(order())
    return F.coalesce((before != "") & (before == after) & (before != F.col("speaker")), F.lit(False))


def speaker_summary(segments: DataFrame) -> DataFrame:
    """Per recording and speaker: segments, seconds, turns, stable turns, and shares of short, filler and sandwiched rows."""
    total = W.partitionBy("rec_id")
    rows = segments.withColumn("total", F.count("*").over(total)).withColumn("between", sandwiched(segments))
    rows = labelled(rows).withColumn("dur", F.expr("greatest(0, end - start)"))
    filler = F.trim("text").rlike(FILLER)
    each = rows.groupBy("rec_id", "speaker").agg(
        F.count("*").alias("segments"),
        F.first("total").alias("total"),
        F.sum("dur").alias("duration_s"),
        F.count_if(F.col("dur") < 1.5).alias("short_segments"),
        F.count_if((F.trim("text") != "") & filler).alias("filler_segments"),
        F.count_if("between").alias("sandwiched_segments"),
    )
    stable = (F.col("end") - F.col("start") >= 4.0) | (F.col("segments") >= 3)
    turned = runs(segments, 1.2).groupBy("rec_id", "speaker").agg(F.count("*").alias("turns"), F.count_if(stable).alias("stable_turns"))
    ratio = lambda c: F.round(F.col(c) / F.col("segments"), 6)
    share = F.col("duration_s") / F.sum("duration_s").over(total)
    return each.join(turned, ["rec_id", "speaker"]).select(
        "rec_id",
        "speaker",
        "segments",
        F.round(F.col("segments") / F.col("total"), 6).alias("segment_ratio"),
        F.round("duration_s", 6).alias("duration_s"),
        F.round(share, 6).alias("duration_ratio"),
        "turns",
        "stable_turns",
        "short_segments",
        ratio("short_segments").alias("short_ratio"),
        "filler_segments",
        ratio("filler_segments").alias("filler_ratio"),
        "sandwiched_segments",
        ratio("sandwiched_segments").alias("sandwiched_ratio"),
    )


def score_candidates(summary: DataFrame, requested: int) -> DataFrame:
    """Score of a labelling per recording from its speaker summary, with the counts of each class of speaker."""
    flags = (
        summary.withColumn("tiny", F.expr("segments <= 2 OR duration_s < 3 OR (stable_turns = 0 AND segments < 6)"))
        .withColumn("weak", F.expr(f"NOT tiny AND (segments < 8 OR duration_s < 10 OR stable_turns = 0 OR ({requested} >= 4 AND duration_s < 18) OR (duration_s < 18 AND stable_turns <= 2))"))
        .withColumn(
            "fragmented",
            F.expr(
                "NOT tiny AND turns >= 5 AND ((duration_s / greatest(1, turns) < 3 AND stable_turns <= 3) OR (short_ratio >= 0.45 AND filler_ratio >= 0.35)"
                " OR (sandwiched_ratio >= 0.18 AND filler_ratio >= 0.3) OR (duration_s < 18 AND short_ratio >= 0.35))"
            ),
        )
        .withColumn("stable", F.expr("NOT tiny AND NOT weak AND NOT fragmented"))
        .withColumn("marginal", F.expr("NOT tiny AND (segment_ratio < 0.015 OR duration_ratio < 0.01)"))
    )
    names = ("stable", "weak", "tiny", "fragmented", "marginal")
    per = flags.groupBy("rec_id").agg(F.count("*").alias("formed"), F.max("segment_ratio").alias("dominant"), *(F.count_if(n).alias(n) for n in names))
    n = F.lit(requested)
    score = F.expr("6.0 * stable + 0.5 * weak - 6.0 * tiny - 4.0 * fragmented - 2.5 * marginal")
    score = score - F.when((n > 2) & (F.col("dominant") > 0.82), (F.col("dominant") - 0.82) * 12).otherwise(0)
    score = score - F.when(n >= 6, F.greatest(F.lit(0), n - F.col("stable")) * 1.4).otherwise(0)
    score = score - F.when(n >= 5, (F.col("weak") + F.col("tiny")) * 1.5).otherwise(0)
    score = score - F.greatest(F.lit(0), n - F.col("formed")) * 2.0 - F.greatest(F.lit(0), n - F.col("stable")) * 0.8
    score = score + F.when(F.col("stable") >= 2, 1.0).otherwise(0) + F.when(F.col("stable") == n, 2.0).otherwise(0) - F.when(F.col("stable") == 0, 8.0).otherwise(0)
    return per.select("rec_id", n.alias("requested"), "formed", *names, F.round(score, 4).alias("score"))


def proxy_metrics(segments: DataFrame, short: float = 1.0, fragment: float = 0.5) -> DataFrame:
    """Label-free signs of over-segmentation per recording, and a risk."""
    rows = segments.withColumn("named", F.expr("speaker IS NOT NULL AND speaker <> ''")).withColumn("dur", F.expr("greatest(0, end - start)"))
    base = rows.groupBy("rec_id").agg(
        (F.max("end") - F.min("start")).alias("span"),
        F.count_if(~F.col("named")).alias("missing_speaker_segments"),
        F.count_if(F.expr("named AND dur > 0")).alias("n"),
        F.sum(F.expr("CASE WHEN named THEN dur ELSE 0 END")).alias("total"),
        F.count_if(F.expr(f"named AND dur > 0 AND dur < {short}")).alias("short_segments"),
        F.count_if(F.expr(f"named AND dur > 0 AND dur < {fragment}")).alias("fragment_segments"),
    )
    turned = runs(segments, None).groupBy("rec_id").agg(F.count("*").alias("turns"))
    most = labelled(rows).groupBy("rec_id", "speaker").agg(F.sum("dur").alias("d")).groupBy("rec_id").agg(F.max("d").alias("top"), F.count("*").alias("speakers"))
    m = base.join(turned, "rec_id", "left").join(most, "rec_id", "left").na.fill(0)
    m = m.withColumn("switches", F.greatest(F.lit(0), F.col("turns") - 1))
    m = m.withColumn("short_ratio", F.expr("short_segments / greatest(1, n)")).withColumn("fragment_ratio", F.expr("fragment_segments / greatest(1, n)"))
    m = m.withColumn("rate", F.expr("CASE WHEN span > 0 THEN switches / (span / 60) ELSE 0 END")).withColumn("dominant", F.expr("CASE WHEN total > 0 THEN top / total ELSE 0 END"))
    high = "fragment_ratio >= 0.25 OR short_ratio >= 0.55 OR rate >= 20"
    some = "fragment_ratio >= 0.12 OR short_ratio >= 0.35 OR rate >= 12 OR (speakers >= 2 AND dominant >= 0.92)"
    risk = F.expr(f"CASE WHEN {high} THEN 'high' WHEN {some} THEN 'medium' ELSE 'low' END")
    r = lambda c: F.round(c, 6).alias(c)
    return m.select("rec_id", "turns", F.col("switches").alias("speaker_switches"), F.round(F.expr("total / greatest(1, n)"), 6).alias("avg_segment_s"), "short_segments", r("short_ratio"), "fragment_segments", r("fragment_ratio"), F.round("rate", 6).alias("switch_rate_per_min"), F.round("dominant", 6).alias("dominant_ratio"), "missing_speaker_segments", risk.alias("proxy_risk"))


def change_points(segments: DataFrame) -> DataFrame:
    """Times at which the speaker differs from the row before."""
    rows = labelled(segments).withColumn("before", F.lag("speaker").over(order()))
    return rows.where("before <> speaker").select("rec_id", F.col("start").alias("time"), F.col("before").alias("from_speaker"), F.col("speaker").alias("to_speaker"))


def run_lengths(segments: DataFrame, max_gap: float = 1.2) -> DataFrame:
    """Rows with the length of the run of like rows around each; unlabelled rows break runs."""
    broken = F.coalesce((F.col("speaker") != F.lag("speaker").over(order())) | (F.col("start") - F.lag("end").over(order()) > max_gap), F.lit(True))
    rows = segments.withColumn("speaker", F.coalesce("speaker", F.lit(""))).withColumn("b", broken.cast("int")).withColumn("g", F.sum("b").over(order()))
    return labelled(rows).select("rec_id", "seg_idx", "speaker", F.count("*").over(W.partitionBy("rec_id", "g")).alias("run_length"))


def nearest_same_gap(segments: DataFrame, window: float = 18.0) -> DataFrame:
    """Gap to the nearest other row of the same speaker, null beyond the window. Starts rise with the order."""
    w = W.partitionBy("rec_id", "speaker").orderBy("seg_idx")
    behind = F.col("start") - F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    ahead = F.lead("start").over(w) - F.col("end")
    gap = F.least(*(F.when(x.isNotNull(), F.greatest(F.lit(0.0), x)) for x in (behind, ahead)))
    return labelled(segments).select("rec_id", "seg_idx", F.round(F.when(gap <= window, gap), 6).alias("gap"))


def context(rows: DataFrame, k: int, text: str = "text") -> DataFrame:
    """Each row with the texts of up to k rows before and after."""
    join = lambda a, b: F.array_join(F.collect_list(text).over(order().rowsBetween(a, b)), " / ")
    return rows.select("rec_id", "seg_idx", join(-k, -1).alias("before"), join(1, k).alias("after"))


def carry_forward(rows: DataFrame, col: str) -> DataFrame:
    """The column with nulls filled by the last value before."""
    return rows.withColumn(col, F.last(col, ignorenulls=True).over(order().rowsBetween(W.unboundedPreceding, 0)))


def first_appearance(segments: DataFrame) -> DataFrame:
    """Speakers of a recording numbered by their first start."""
    first = labelled(segments).groupBy("rec_id", "speaker").agg(F.min(F.struct("start", "seg_idx")).alias("at"))
    return first.select("rec_id", "speaker", F.row_number().over(W.partitionBy("rec_id").orderBy("at")).alias("place"))


def batches(rows: DataFrame, size: int) -> DataFrame:
    """Fixed batches of consecutive rows."""
    return rows.withColumn("batch", F.floor((F.row_number().over(order()) - 1) / size).cast("int"))


def merge_windows(windows: DataFrame, tolerance: float) -> DataFrame:
    """Windows (rec_id, start, end) whose gap is at most the tolerance, merged; n counts members."""
    w = W.partitionBy("rec_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = windows.withColumn("b", F.coalesce((F.col("start") > reach + tolerance).cast("int"), F.lit(1))).withColumn("g", F.sum("b").over(w))
    return rows.groupBy("rec_id", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("g")


def rapid_alternation(segments: DataFrame, span: float = 52.0, rows: int = 6, switches: int = 4) -> DataFrame:
    """Rows from which a span holds enough rows of exactly two speakers that switch often: candidates before skipping ahead."""
    w = W.partitionBy("rec_id").orderBy(F.round(F.col("start") * 1000).cast("long")).rangeBetween(0, int(span * 1000))
    flip = labelled(segments).withColumn("flip", F.coalesce((F.col("speaker") != F.lag("speaker").over(order())).cast("int"), F.lit(0)))
    seen = flip.select("rec_id", "seg_idx", F.count("*").over(w).alias("rows"), (F.sum("flip").over(w) - F.col("flip")).alias("switches"), F.size(F.collect_set("speaker").over(w)).alias("speakers"))
    return seen.where((F.col("rows") >= rows) & (F.col("speakers") == 2) & (F.col("switches") >= switches))


def smooth_sandwiched(segments: DataFrame, most: int = 3, seconds: tuple[float, float] = (1.0, 25.0), around: float = 4.0) -> DataFrame:
    """Runs of few rows between two long runs of one other speaker, with the speaker they would get."""
    r = runs(segments, None)
    w = W.partitionBy("rec_id").orderBy("run_idx")
    dur = F.col("end") - F.col("start")
    r = r.withColumn("dur", dur).select("*", F.lag("speaker").over(w).alias("before"), F.lead("speaker").over(w).alias("after"), F.lag("dur").over(w).alias("db"), F.lead("dur").over(w).alias("da"))
    hit = (F.col("before") == F.col("after")) & (F.col("segments") <= most) & F.col("dur").between(*seconds) & (F.col("db") >= around) & (F.col("da") >= around)
    return r.where(hit).select("rec_id", "first_idx", "last_idx", F.col("speaker").alias("from_speaker"), F.col("before").alias("to_speaker"))
