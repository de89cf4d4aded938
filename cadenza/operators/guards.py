"""Guards of the choice of a number of speakers, over candidate labellings.

A candidate is a row (rec_id, k, formed, stable, weak, tiny, fragmented, marginal, severe, score, model_n,
confidence, selected_score, recommended_score): a labelling with k speakers asked for and formed ones
found, its classes of speakers, how many voices it mixes badly, its score and what a model says of it.
A recording has a handful of candidates; every guard is joins and aggregates on rec_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.review import consistent_recommendations


def _pairs(candidates: DataFrame) -> DataFrame:
    """Each candidate c with every candidate o of its recording."""
    one = candidates.select("rec_id", F.struct(*candidates.columns).alias("c"))
    return one.join(candidates.select("rec_id", F.struct(*candidates.columns).alias("o")), "rec_id")


def penalised(anchor: Column, higher: Column, recommended: Column, margin: float = 0.03) -> Column:
    """Whether the model scores the higher count lower by the margin; its recommended score stands in for a missing one."""
    known = anchor.isNotNull() & higher.isNotNull()
    gap = F.coalesce(anchor, recommended) - F.coalesce(higher, recommended)
    return F.when(known | recommended.isNotNull(), F.round(gap, 9) >= margin).otherwise(False)


def model_penalties(candidates: DataFrame, margin: float = 0.03) -> DataFrame:
    """(rec_id, k, higher, penalised) of each candidate and each with more speakers asked for."""
    p = _pairs(candidates).where("o.k > c.k")
    said = penalised(F.col("c.selected_score"), F.col("o.selected_score"), F.col("o.recommended_score"), margin)
    return p.select("rec_id", F.col("c.k").alias("k"), F.col("o.k").alias("higher"), said.alias("penalised"))


def under_count(candidates: DataFrame) -> DataFrame:
    """(rec_id, k, refined): the candidate with one speaker more that a confident model and badly mixed voices call for."""
    p = _pairs(candidates).where("c.model_n > c.formed AND c.confidence >= 0.4 AND c.severe > 0")
    p = p.where("o.formed = c.formed + 1 AND o.formed <= c.model_n AND o.weak + o.tiny <= c.weak + c.tiny AND o.stable >= o.formed")
    return p.groupBy("rec_id", F.col("c.k").alias("k")).agg(F.max(F.struct(F.col("o.score").alias("s"), (-F.col("o.k")).alias("n"))).alias("x")).select("rec_id", "k", (-F.col("x.n")).alias("refined"))


def conflict(candidates: DataFrame, structural: str) -> DataFrame:
    """(rec_id, k, refined): a limited move to more speakers where a candidate's split is structural.

    ``structural`` is a condition on c and o. At most two more, and four in all where the model says two or fewer; then the
    most speakers, else the fewest, by score among equals.
    """
    most = F.when(F.col("c.model_n") <= 2, F.least(F.col("c.formed") + 2, F.lit(4))).otherwise(F.least(F.col("c.formed") + 2, F.lit(8)))
    p = _pairs(candidates).where((F.col("o.formed") > F.col("c.formed")) & (F.col("o.formed") <= most)).where(structural)
    pick = lambda sign: F.max(F.struct((sign * F.col("o.formed")).alias("f"), F.col("o.score").alias("s"), (-F.col("o.k")).alias("n")))
    g = p.groupBy("rec_id", F.col("c.k").alias("k"), F.col("c.model_n").alias("m")).agg(pick(1).alias("more"), pick(-1).alias("fewer"))
    return g.select("rec_id", "k", (-F.when(F.col("m") <= 2, F.col("more.n")).otherwise(F.col("fewer.n"))).alias("refined"))


def _consistent(candidates: DataFrame) -> DataFrame:
    said = consistent_recommendations(candidates.select("rec_id", "k", F.col("model_n").alias("model")))
    return candidates.join(said.where("consistent").select("rec_id", F.col("model").alias("model_n")), ["rec_id", "model_n"])


def trusted_high(candidates: DataFrame, summary: DataFrame) -> DataFrame:
    """(rec_id, k): anchors of five speakers or more that the model confirms and whose every speaker has durable support.

    ``summary`` has (rec_id, k, speaker, segments, duration_s, stable_turns).
    """
    good = _consistent(candidates).where("model_n >= 5 AND formed = model_n AND confidence >= 0.4 AND tiny = 0 AND fragmented = 0 AND marginal = 0")
    held = summary.groupBy("rec_id", "k").agg(F.count("*").alias("n"), F.bool_and(F.expr("segments >= 5 AND duration_s >= 20 AND stable_turns >= 1")).alias("lasting"))
    return good.join(held, ["rec_id", "k"]).where("lasting AND n = model_n").select("rec_id", "k")


def medium_fallback(candidates: DataFrame) -> DataFrame:
    """(rec_id, k, fallback): one speaker fewer where a medium-confidence three or four stays badly mixed and the lower labelling is clean."""
    high = _consistent(candidates).where("model_n IN (3, 4) AND formed = model_n AND confidence >= 0.4 AND confidence < 0.7 AND severe >= greatest(1, (formed + 1) div 2)")
    p = high.select("rec_id", F.struct("k", "formed").alias("c")).join(candidates.select("rec_id", F.struct(*candidates.columns).alias("o")), "rec_id")
    p = p.where("o.formed = c.formed - 1 AND o.tiny + o.weak + o.fragmented + o.marginal = 0 AND o.stable >= c.formed - 1")
    p = p.where("o.recommended_score > 0 AND round(o.selected_score / o.recommended_score, 9) >= 0.45")
    best = F.max(F.struct((F.col("o.k") == F.col("c.formed") - 1).alias("e"), F.col("o.score").alias("s"), (-F.col("o.k")).alias("n")))
    return p.groupBy("rec_id", F.col("c.k").alias("k")).agg(best.alias("x")).select("rec_id", "k", (-F.col("x.n")).alias("fallback"))


def weak_tail(candidates: DataFrame, summary: DataFrame, meaningful: str) -> DataFrame:
    """(rec_id, k, higher): candidates with one more of five speakers or more that rides on a weak tail.

    ``summary`` has (rec_id, k, speaker, fragile, turns, stable_turns, segment_ratio, duration_s); ``meaningful`` is a condition on c
    and o under which the split counts as real.
    """
    tail = F.bool_or(F.expr("fragile AND (turns <= 1 OR stable_turns <= 1 OR segment_ratio < 0.035 OR duration_s < 45)"))
    near = F.bool_or(F.expr("NOT fragile AND turns <= 3 AND stable_turns <= 3 AND duration_s < 90"))
    shape = summary.groupBy("rec_id", "k").agg(tail.alias("tail"), near.alias("near")).where("tail AND near").select("rec_id", F.col("k").alias("higher"))
    p = _pairs(candidates).where("c.formed >= 3 AND o.formed >= 5 AND o.formed = c.formed + 1 AND o.tiny + o.weak + o.fragmented + o.marginal > 0 AND c.stable >= o.stable - 1")
    return p.where(~F.expr(meaningful)).select("rec_id", F.col("c.k").alias("k"), F.col("o.k").alias("higher")).join(shape, ["rec_id", "higher"]).select("rec_id", "k", "higher")
