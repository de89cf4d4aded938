"""Integrity: what a labelling must not change, and what a transcript must satisfy. Violations are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

def order() -> WindowSpec:
    return W.partitionBy("rec_id").orderBy("seg_idx")


def violations(segments: DataFrame, overlap: float = 0.05) -> DataFrame:
    """(rec_id, seg_idx, code) of every broken rule."""
    segments = segments.withColumn("_s", F.lag("start").over(order())).withColumn("_e", F.lag("end").over(order()))
    finite = F.expr("start IS NOT NULL AND end IS NOT NULL AND NOT isnan(start) AND NOT isnan(end)")
    rules = {
        "not_finite": ~finite,
        "negative": F.col("start") < 0,
        "not_positive": F.col("end") <= F.col("start"),
        "start_falls": F.col("start") < F.col("_s"),
        "end_falls": F.col("end") < F.col("_e"),
        "overlap": F.col("_e") - F.col("start") > overlap,
        "empty": F.trim(F.coalesce("text", F.lit(""))) == "",
        "no_speaker": F.col("speaker").isNull(),
    }
    codes = F.filter(F.array(*(F.when(c, k) for k, c in rules.items())), lambda x: x.isNotNull())
    return segments.select("rec_id", "seg_idx", F.explode(codes).alias("code"))


def geometry(source: DataFrame, target: DataFrame) -> DataFrame:
    """Positions at which text or times differ, or that only one side has."""
    t = target.select(*(F.col(c).alias(f"t_{c}") for c in ("rec_id", "seg_idx", "start", "end", "text")))
    both = source.join(t, (F.col("rec_id") == F.col("t_rec_id")) & (F.col("seg_idx") == F.col("t_seg_idx")), "full")
    same = F.expr("start <=> t_start AND end <=> t_end AND text <=> t_text AND rec_id <=> t_rec_id")
    return both.where(~same).select(F.coalesce("rec_id", "t_rec_id").alias("rec_id"), F.coalesce("seg_idx", "t_seg_idx").alias("seg_idx"))


def partitions(source: DataFrame, target: DataFrame, slack: float = 1e-6) -> DataFrame:
    """Per source row: whether target rows that lie in it tile it and spell its text."""
    from cadenza.operators.intervals import overlap_join

    inside = overlap_join(source.select("rec_id", "seg_idx", "start", "end", "text"), target.select("rec_id", "start", "end", "text"))
    inside = inside.where(F.expr(f"r_start >= start - {slack} AND r_end <= end + {slack}"))
    w = W.partitionBy("rec_id", "seg_idx").orderBy("r_start")
    inside = inside.withColumn("gap", F.abs(F.col("r_start") - F.coalesce(F.lag("r_end").over(w), F.col("start"))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_start", "r_text"))), lambda x: x["r_text"]), "")
    per = inside.groupBy("rec_id", "seg_idx", "end", "text").agg(F.max("gap").alias("gap"), F.max("r_end").alias("last"), text.alias("said"))
    ok = F.expr(f"gap <= {slack} AND abs(last - end) <= {slack} AND said = text")
    return source.select("rec_id", "seg_idx").join(per.select("rec_id", "seg_idx", ok.alias("ok")), ["rec_id", "seg_idx"], "left").select("rec_id", "seg_idx", F.coalesce("ok", F.lit(False)).alias("preserved"))


def timeline_hash(segments: DataFrame) -> DataFrame:
    """SHA-256 of all times of a recording in order, at microseconds."""
    line = F.concat(F.lit("s:"), F.format_string("%.6f", F.col("start")), F.lit(":"), F.format_string("%.6f", F.col("end")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("l")))), lambda x: x["l"])
    return segments.groupBy("rec_id").agg(F.sha2(F.array_join(lines, "|"), 256).alias("sha256"))


def complete_labels(segments: DataFrame) -> DataFrame:
    return segments.groupBy("rec_id").agg(F.bool_and(F.expr("speaker IS NOT NULL AND speaker <> ''")).alias("complete"))


def exported_lines(exports: DataFrame, segments: DataFrame) -> DataFrame:
    """(rec_id, seg_idx, same): each segment with text against the line in its place of the exported text (rec_id, content)."""
    lines = exports.select("rec_id", F.posexplode(F.filter(F.split("content", "\n"), lambda x: x != "")).alias("place", "line"))
    w = W.partitionBy("rec_id").orderBy("seg_idx")
    rows = segments.where("trim(text) <> ''").withColumn("place", F.row_number().over(w) - 1)
    said = F.regexp_extract("line", r"^\[[0-9:.]+ - [0-9:.]+\] (.*)$", 1)
    both = rows.join(lines, ["rec_id", "place"], "left")
    return both.select("rec_id", "seg_idx", F.coalesce(said == F.trim("text"), F.lit(False)).alias("same"))
