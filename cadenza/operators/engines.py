"""Two engines' labels of the same segments: a mapping, the rows it leaves different, assignments by score; windows as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators import folds


def engine_mapping(rows: DataFrame) -> DataFrame:
    """(rec_id, speaker, mapped) from rows (rec_id, seg_idx, speaker, other) whose labels both are set.

    Speakers choose in order of appearance: the label they meet most often, of equal ones the first met,
    that nobody chose before. One who finds none has no row. Only counts of label pairs meet in a group.
    """
    met = rows.groupBy("rec_id", "speaker", "other").agg(F.count("*").alias("n"), F.min("seg_idx").alias("first"))

    def choose(counts: list[dict]) -> list[dict]:
        since: dict[str, int] = {}
        for c in counts:
            since[c["speaker"]] = min(c["first"], since.get(c["speaker"], c["first"]))
        taken: dict[str, str] = {}
        for c in sorted(counts, key=lambda c: (since[c["speaker"]], -c["n"], c["first"])):
            if c["speaker"] not in taken and c["other"] not in taken.values():
                taken[c["speaker"]] = c["other"]
        return [{"speaker": a, "mapped": b} for a, b in taken.items()]

    return folds.grouped(met, choose, "rec_id long, speaker string, mapped string", order=("first", "other"))


def cross_engine(segments: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows at one position whose mapped label isn't the reference's, of recordings with equally many segments.

    Both are (rec_id, seg_idx, speaker); rows without a label on either side take no part.
    """
    size = lambda d, c: d.groupBy("rec_id").agg(F.count("*").alias(c))
    even = size(segments, "n").join(size(reference, "m"), "rec_id").where("n = m").select("rec_id")
    other = reference.select("rec_id", "seg_idx", F.col("speaker").alias("other"))
    rows = segments.select("rec_id", "seg_idx", "speaker").join(other, ["rec_id", "seg_idx"]).where("speaker <> '' AND other <> ''").join(even, "rec_id", "left_semi")
    return rows.join(engine_mapping(rows), ["rec_id", "speaker"], "left").where("NOT (mapped <=> other)").select("rec_id", "seg_idx", "speaker", F.col("mapped"), F.col("other").alias("reference"))


def profile_assignment(scores: DataFrame, least: float) -> DataFrame:
    """(rec_id, speaker, profile, score): the one-to-one assignment of greatest total among scores of at least ``least``, a positive number."""
    sure = scores.where(F.col("score") >= least).groupBy("rec_id", "speaker", "profile").agg(F.max("score").alias("score"))

    def assign(rows: list[dict]) -> list[dict]:
        of = {(r["speaker"], r["profile"]): r["score"] for r in rows}
        return [{"speaker": a, "profile": b, "score": of[a, b]} for a, b in folds.best_assignment(of).items()]

    return folds.grouped(sure, assign, "rec_id long, speaker string, profile string, score double", order=("speaker", "profile"))


def window_bounds(raw: str) -> Column:
    """(start, end, reason) of a window as JSON, an object or an array; null where it has no bounds or no length."""
    part = lambda name, i: F.when(F.ltrim(F.col(raw)).startswith("{"), F.get_json_object(raw, f"$.{name}")).when(F.ltrim(F.col(raw)).startswith("["), F.get_json_object(raw, f"$[{i}]"))
    start, end = part("start", 0).try_cast("double"), part("end", 1).try_cast("double")
    return F.when(end > start, F.struct(start.alias("start"), end.alias("end"), F.coalesce(part("reason", 2), F.lit("unknown")).alias("reason")))
