"""What a person should listen to, which labelling to prefer, and which recovered text to trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators.runs import labelled, runs, score_candidates, speaker_summary


def local_jumps(segments: DataFrame, around: float = 8.0, short: tuple[int, float] = (2, 8.0)) -> DataFrame:
    """Short runs of weakly supported speakers between two longer runs, with the speaker to try instead."""
    stats = speaker_summary(segments).select("rec_id", "speaker", (F.expr("stable_turns <= 2 OR duration_ratio <= 0.06 OR segment_ratio <= 0.06")).alias("weak"))
    w = W.partitionBy("rec_id").orderBy("run_idx")
    r = runs(segments).withColumn("dur", F.col("end") - F.col("start"))
    for name, f in (("before", F.lag), ("after", F.lead)):
        r = r.withColumn(name, f("speaker").over(w)).withColumn(f"{name}_s", f("dur").over(w))
    hit = (F.col("speaker") != F.col("before")) & (F.col("speaker") != F.col("after")) & (F.col("before_s") >= around) & (F.col("after_s") >= around)
    hit = hit & ((F.col("segments") <= short[0]) | (F.col("dur") <= short[1]))
    rows = r.where(hit).join(stats.where("weak"), ["rec_id", "speaker"], "left_semi")
    return rows.select("rec_id", "first_idx", "last_idx", F.col("speaker").alias("from_speaker"), F.when(F.col("before") == F.col("after"), F.col("before")).otherwise(F.col("speaker")).alias("to_speaker"))


def first_rows(segments: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """The first k rows of every chosen (rec_id, speaker)."""
    rows = segments.join(chosen.select("rec_id", "speaker"), ["rec_id", "speaker"], "left_semi")
    place = F.row_number().over(W.partitionBy("rec_id", "speaker").orderBy("seg_idx"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("rec_id", "speaker", "seg_idx", "place")


def least_supported(summary: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("rec_id").orderBy("duration_ratio", "segment_ratio", "stable_turns", "speaker")
    return summary.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def candidates(segments: DataFrame, counts: tuple[int, ...], label) -> DataFrame:
    """One scored labelling per recording and requested count; label gives the speaker expression for a count."""
    out = None
    for k in counts:
        one = score_candidates(speaker_summary(segments.withColumn("speaker", label(k))), k)
        out = one if out is None else out.unionByName(one)
    return out


def chosen(scored: DataFrame) -> DataFrame:
    """Per recording the best candidate, its lead over the next, and how far to trust it."""
    w = W.partitionBy("rec_id").orderBy(F.desc("score"), F.desc("stable"), "weak", "tiny", "requested")
    r = scored.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w)).where("_r = 1")
    gap = F.round(F.col("score") - F.coalesce("_next", F.lit(-999.0)), 3)
    fragile = F.col("tiny") + F.col("weak") + F.col("fragmented") + F.col("marginal")
    sure = F.when((gap >= 5) & (fragile == 0), "high").when((gap >= 2) & (fragile <= 1), "medium").otherwise("low")
    return r.select("rec_id", "requested", "score", gap.alias("gap"), sure.alias("confidence"))


def minor_split(lower: DataFrame, higher: DataFrame) -> DataFrame:
    """Recordings whose one more speaker is small, given (rec_id, speaker, ...) summaries of both labellings."""
    count = lambda s, n: s.groupBy("rec_id").agg(F.count("*").alias(n))
    least = higher.groupBy("rec_id").agg(F.min(F.struct("duration_s", "segments", "duration_ratio", "segment_ratio", "stable_turns", "turns")).alias("m"))
    rows = count(lower, "lo").join(count(higher, "hi"), "rec_id").join(least, "rec_id").where("lo >= 2 AND hi = lo + 1")
    small = F.expr("m.duration_s < 35 OR m.duration_ratio < 0.12 OR m.segment_ratio < 0.12 OR m.stable_turns <= 2 OR m.turns <= 6")
    return rows.select("rec_id", "lo", "hi", small.alias("minor"))


def splits(lower: DataFrame, higher: DataFrame) -> DataFrame:
    """How the rows and seconds of each speaker of one labelling fall to the speakers of another."""
    h = higher.select("rec_id", "seg_idx", F.col("speaker").alias("child"))
    rows = labelled(lower).join(h, ["rec_id", "seg_idx"]).where("child IS NOT NULL")
    per = rows.groupBy("rec_id", F.col("speaker").alias("parent"), "child").agg(F.count("*").alias("rows"), F.round(F.sum(F.col("end") - F.col("start")), 6).alias("seconds"))
    return per.withColumn("share", F.round(F.col("seconds") / F.sum("seconds").over(W.partitionBy("rec_id", "parent")), 6))


def merge_map(lower: DataFrame, higher: DataFrame) -> DataFrame:
    """Each finer speaker's coarser one by seconds (ties: least name)."""
    s = splits(lower, higher)
    w = W.partitionBy("rec_id", "child").orderBy(F.desc("seconds"), "parent")
    return s.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("rec_id", "child", "parent", "seconds")


# Recovery of text from several attempts (window, provider_kind, provider, family, framing, slice, status, value, risky).


def attempt_status(normalized: Column, reference: Column, residual: Column, least: int, risky: Column) -> tuple[Column, Column]:
    """(status, reason) of one attempt; the order of the tests matters."""
    repeated = lambda c: c.rlike(r"^(.{1,12}?)\1{2,}$")
    reason = (
        F.when(normalized == "", "empty_candidate")
        .when(F.contains(reference, normalized), None)
        .when(reference != "", "overlapping_reference_unresolved")
        .when(F.length(normalized) < least, F.when(F.length(normalized) < 2, "single_character").otherwise("low_text_density"))
        .when(repeated(normalized), "repeated_hallucination")
        .when(risky, "provider_hallucination_risk")
        .when(F.length(residual) < least, F.when(F.length(residual) < 2, "residual_too_short").otherwise("low_text_density"))
        .when(repeated(residual), "repeated_hallucination")
    )
    status = F.when((normalized != "") & F.contains(reference, normalized), "matched_existing").when(reason.isNotNull(), "rejected").otherwise("valid")
    return status, F.when(status == "rejected", reason)


def stable_primary(attempts: DataFrame, status: str) -> DataFrame:
    """(window, value, framings): per window the value that most framings and at least two slices give."""
    a = attempts.where((F.col("status") == status) & (F.col("provider_kind") == "primary") & ~F.col("risky") & (F.col("value") != ""))
    last = a.groupBy("window", "value", "framing").agg(F.max_by("slice", "attempt").alias("slice"))
    per = last.groupBy("window", "value").agg(F.count("*").alias("framings"), F.count_distinct("slice").alias("slices"), F.bool_and(F.col("slice") != "").alias("all"))
    good = per.where("framings >= 2 AND slices >= 2 AND all")
    return good.groupBy("window").agg(F.min(F.struct((-F.col("framings")).alias("n"), "value")).alias("m")).select("window", F.col("m.value").alias("value"), (-F.col("m.n")).alias("framings"))


def independent(attempts: DataFrame, status: str) -> DataFrame:
    """(window, value) that a provider of another family than all primary ones gives."""
    primary = attempts.where("provider_kind = 'primary'").select("window", "family").distinct()
    a = attempts.where((F.col("status") == status) & (F.col("provider_kind") == "independent") & ~F.col("risky") & (F.col("slice") != ""))
    return a.join(primary, ["window", "family"], "left_anti").select("window", "value").distinct()


def recovery(attempts: DataFrame) -> DataFrame:
    """(window, decision, value): existing text that two families confirm, else new text that is stable and confirmed, else nothing."""
    single = attempts.where("status = 'matched_existing' AND provider_kind = 'primary' AND value <> '' AND slice <> ''").select("window", "value").distinct()
    existing = single.join(independent(attempts, "matched_existing"), ["window", "value"]).groupBy("window").agg(F.min("value").alias("existing"))
    insert = stable_primary(attempts, "valid").join(independent(attempts, "valid"), ["window", "value"]).where("length(value) >= 2").select("window", F.col("value").alias("new"))
    all_ = attempts.groupBy("window").agg(F.bool_and(F.col("status") == "error").alias("failed"))
    rows = all_.join(existing, "window", "left").join(insert, "window", "left")
    decision = F.when(F.col("existing").isNotNull(), "matched_existing").when(F.col("new").isNotNull(), "insert_accepted").when(F.col("failed"), "error").otherwise("rejected")
    return rows.select("window", decision.alias("decision"), F.coalesce("existing", "new", F.lit("")).alias("value"))


def llm_merge(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Texts with the answers by position; blank or missing answers leave the text."""
    a = answers.select("rec_id", "seg_idx", F.col("text").alias("answer"))
    return rows.join(a, ["rec_id", "seg_idx"], "left").select("rec_id", "seg_idx", F.coalesce(F.nullif(F.trim("answer"), F.lit("")), F.col("text")).alias("text"))


def disagreement(ab: Column, ac: Column, bc: Column, length_penalty: Column) -> Column:
    """Score in 0..1 from three similarities, a being the text in question."""
    mean = (ab + ac) / 2
    return F.least(F.lit(1.0), 0.62 * (1 - mean) + 0.25 * F.greatest(F.lit(0.0), bc - mean) + 0.13 * length_penalty)


def consistent_recommendations(candidates: DataFrame) -> DataFrame:
    """(rec_id, model, votes, compatible, consistent) from candidates (rec_id, k, model).

    A recommended number of speakers is consistent if, of the candidates with at least as many (and two), six in ten and
    two at least recommend it.
    """
    times = candidates.groupBy("rec_id", "k", "model").agg(F.count("*").alias("n"))  # few rows a recording
    said = times.select("rec_id", F.col("model").alias("said")).distinct()
    met = said.join(times, "rec_id").where("k >= greatest(2, said)")
    per = met.groupBy("rec_id", "said").agg(F.sum(F.when(F.col("model") == F.col("said"), F.col("n")).otherwise(0)).alias("votes"), F.sum("n").alias("compatible"))
    rows = said.join(per, ["rec_id", "said"], "left").na.fill(0)
    yes = F.expr("said > 0 AND compatible > 0 AND votes >= greatest(2, floor(0.6 * compatible))")
    return rows.select("rec_id", F.col("said").alias("model"), "votes", "compatible", yes.alias("consistent"))


def auto_merge(summary: DataFrame) -> DataFrame:
    """(rec_id, merge): whether speakers marked mergeable may be merged at once, from speaker summaries with a column mergeable.

    Four speakers or more: yes. Three: if a mergeable one is short, rare, or made of short fillers.
    """
    slight = F.expr("mergeable AND (duration_s < 18 OR segment_ratio < 0.04 OR (turns >= 5 AND short_ratio >= 0.55 AND filler_ratio >= 0.45))")
    per = summary.groupBy("rec_id").agg(F.count("*").alias("n"), F.bool_or("mergeable").alias("some"), F.bool_or(slight).alias("slight"))
    return per.select("rec_id", F.expr("some AND (n >= 4 OR (n = 3 AND slight))").alias("merge"))


#: Kinds of wrong sequences: a missed change, an extra one, wrong speakers or order.
MISSED, EXTRA, WRONG = "漏掉换人", "额外误切", "人员或顺序错误"


def collapsed(labels: Column) -> Column:
    """An array of labels without repeats in a row."""
    return F.filter(labels, lambda x, i: (i == 0) | ~x.eqNullSafe(F.try_element_at(labels, i)))


def error_type(current: Column, gold: Column) -> Column:
    """Of two sequences of labels: empty if they collapse to the same, else what is wrong with the current one."""
    a, b = collapsed(current), collapsed(gold)
    kind = F.when(F.size(a) < F.size(b), MISSED).when(F.size(a) > F.size(b), EXTRA).otherwise(WRONG)
    return F.when(a == b, "").otherwise(kind)
