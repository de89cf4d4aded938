"""Layers that drop unlikely segments: silence, low probability, repetition, density, phrases, likeness.

All are expressions and windows over (rec_id); a layer sees what the ones before it have left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.functions import udfs
from cadenza.operators.joins import in_ranges
from cadenza.operators.runs import order

#: What is cut from a text's end before phrases are looked up.
TAIL = "[，。！？,.!? ]+$"


def low_logprob(logprob: Column, least: float = -1.0) -> Column:
    """Mean log probability below the least; 0 means that none is known."""
    return (logprob != 0) & (logprob < least)


def has_phrase(text: str, phrases: Sequence[str]) -> Column:
    bare = F.regexp_replace(F.trim(text), TAIL, "")
    hit = F.lit(False)
    for p in phrases:
        hit = hit | bare.contains(p)
    return hit


def weak_phrase(rows: DataFrame, phrases: Sequence[str], silence: float = 5.0) -> Column:
    """Rows with a weak phrase that follow or precede another, or have silence on a side.

    A row without a weak neighbour has neighbours that stay, so gaps to the adjacent rows decide.
    """
    hit = has_phrase("text", phrases)
    beside = F.coalesce(F.lag(hit).over(order()) | F.lead(hit).over(order()), F.lag(hit).over(order()), F.lead(hit).over(order()), F.lit(False))
    before = F.col("start") - F.coalesce(F.lag("end").over(order()), F.lit(0.0)) >= silence
    after = F.coalesce(F.lead("start").over(order()) - F.col("end") >= silence, F.lit(True))
    return hit & (beside | before | after)


def like_triples(rows: DataFrame, ratio: float = 0.9) -> DataFrame:
    """``rows`` with ``repeats``: the second and third of each three like texts in a row.

    Rows whose texts are like the one before form an island. Threes are taken from its start, so that
    a row goes unless its place in the island is a multiple of three or its three isn't whole.
    """
    alike = F.coalesce(udfs.similarity("text", "prev_text") >= ratio, F.lit(False))
    rows = rows.withColumn("prev_text", F.lag("text").over(order())).withColumn("alike", alike).drop("prev_text")
    rows = rows.withColumn("island", F.sum((~F.col("alike")).cast("int")).over(order()))
    w = W.partitionBy("rec_id", "island")
    place, size = F.row_number().over(w.orderBy("seg_idx")) - 1, F.count("*").over(w)
    rows = rows.withColumn("place", place).withColumn("size", size)
    return rows.withColumn("repeats", F.expr("place % 3 <> 0 AND place - place % 3 + 2 < size")).drop("alike", "island", "place", "size")


def filtered(segments: DataFrame, ranges: DataFrame, logprob: str, strong: Sequence[str], weak: Sequence[str], silence: float = 5.0, ratio: float = 0.9) -> DataFrame:
    """(rec_id, seg_idx, reason) of every segment: the first layer that drops it, or kept."""
    rows = segments.select("rec_id", "seg_idx", "start", "end", "text", F.col(logprob).alias("logprob"))
    heard = in_ranges(rows, ranges).select("rec_id", "seg_idx", F.lit(True).alias("heard"))
    rows = rows.join(heard, ["rec_id", "seg_idx"], "left")
    first = F.when(F.col("heard").isNull(), "vad").when(low_logprob(F.col("logprob")), "logprob").when(tx.repetitive("text"), "repetition")
    first = first.when(tx.dense("text", "start", "end"), "density").when(has_phrase("text", strong), "phrase")
    rows = rows.withColumn("reason", first).select("rec_id", "seg_idx", "start", "end", "text", "reason")
    gone, left = rows.where("reason IS NOT NULL"), rows.where("reason IS NULL")
    left = left.withColumn("reason", F.when(weak_phrase(left, weak, silence), "weak_phrase"))
    gone, left = gone.unionByName(left.where("reason IS NOT NULL")), left.where("reason IS NULL")
    left = like_triples(left, ratio).withColumn("reason", F.when(F.col("repeats"), "similar").otherwise("kept")).drop("repeats")
    return gone.unionByName(left).select("rec_id", "seg_idx", "reason")
