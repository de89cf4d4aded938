"""Terms and rewrites: candidates for inconsistent spellings, confirmation in context, audits."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.udfs import similarity


def occurrences(rows: DataFrame, key: str, text: str = "text", least: int = 4) -> DataFrame:
    """(term, key, pos) of words of at least so many letters, in lower case."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0))
    return rows.select(key, F.posexplode(words).alias("pos", "term"))


def near_terms(occ: DataFrame, key: str, ratio: float = 0.67, rare: int = 3, common: int = 10) -> DataFrame:
    """Rare terms with a common one of equal length and first letter that is spelt nearly the same, best first.

    Terms are counted before any pair is made, and pairs are made within (length, first letter)
    between the two classes only.
    """
    count = occ.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct(key).alias("rows"))
    block = [F.length("term").alias("len"), F.left("term", F.lit(2)).alias("head")]
    a = count.where(F.col("n") <= rare).select("term", "n", *block)
    b = count.where(F.col("n") >= common).select(F.col("term").alias("canonical"), F.col("n").alias("m"), *block)
    pairs = a.join(b, ["len", "head"]).where(F.levenshtein("term", "canonical") <= F.ceil(F.col("len") * (1 - ratio)))
    scored = pairs.withColumn("score", F.round(similarity("term", "canonical"), 6)).where(F.col("score") >= ratio)
    best = F.row_number().over(W.partitionBy("term").orderBy(F.desc("score"), F.desc("m"), "canonical"))
    return scored.withColumn("rank", best).where("rank = 1").select("term", "canonical", "n", "m", "score")


def sliding_fragment(a: str | Column, b: str | Column) -> Column:
    """One is the other moved by a character."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    n = F.length(x)
    shifted = lambda p, q: F.substring(p, 2, 1000) == F.left(q, F.length(q) - 1)
    return (n == F.length(y)) & (n >= 3) & (x != y) & (shifted(x, y) | shifted(y, x))


def confirmed(text: Column, left: Column, replacement: Column, right: Column, least: int, most: int) -> Column:
    """The replacement with some of its context on both sides is in the text."""
    ks = F.sequence(F.lit(most), F.lit(least), F.lit(-1))
    return F.exists(ks, lambda k: F.contains(text, F.concat(F.right(left, k), replacement, F.left(right, k))))


def audit(ab: Column, ac: Column, bc: Column, threshold: float = 0.5) -> Column:
    """What three similarities say of a text (a) against two others."""
    mean = (ab + ac) / 2
    return (
        F.when((ab < threshold) & (ac < threshold), "severe_low_similarity")
        .when((bc >= 0.78) & (mean <= 0.72), "auxiliary_consensus")
        .when((ab >= 0.85) & (ac >= 0.85) & (bc >= 0.85), "consistent")
        .otherwise("review")
    )


def cue_evidence(score: Column, margin: Column, coverage: Column, voiced: Column, overlap: Column) -> Column:
    """assign, review or insufficient for a cue's best speaker."""
    heard = (voiced >= 0.30) & (coverage >= 0.15) & (overlap < 0.08)
    sure = ((score >= 0.72) & (margin >= 0.06)) | ((score >= 0.67) & (margin >= 0.12) & (coverage >= 0.5))
    return F.when(heard & sure, "assign").when(heard & (score >= 0.64), "review").otherwise("insufficient")


def voice_blocks(pitch: Column, source: Column, target: Column) -> Column:
    """A move is blocked where the pitch is nearer its source by over 18 Hz and the two lie 45 Hz apart on either side of the middle."""
    nearer = F.abs(pitch - target) - F.abs(pitch - source) > 18
    low, high = F.least(source, target), F.greatest(source, target)
    return F.coalesce(nearer & (low < 155) & (high > 185) & (high - low >= 45), F.lit(False))


def nearest_grams(term: str, text: str, k: int, letter: re.Pattern[str]) -> list[tuple[str, float]]:
    """The k different n-grams of the text without its blanks that are nearest to the term, but not the term; of equals the shorter, then the earlier."""
    term, text = term.strip(), re.sub(r"\s+", "", text)
    least, chars = 0.5 if len(term) <= 2 else 0.62, set(term)
    found: dict[str, float] = {}
    for size in range(max(2, len(term) - 1), min(len(term) + 1, max(len(term), 8)) + 1) if len(term) >= 2 else ():
        for gram in dict.fromkeys(text[i : i + size] for i in range(len(text) - size + 1)):
            # No more characters can match than the term has at all.
            if gram != term and letter.search(gram) and 2.0 * sum(c in chars for c in gram) / (len(term) + size) >= least:
                if (score := SequenceMatcher(None, term, gram).ratio()) >= least:
                    found[gram] = score
    return [(x, round(y, 3)) for x, y in sorted(found.items(), key=lambda item: -item[1])[:k]]


def hotword_candidates(rows: DataFrame, key: str, terms: DataFrame, k: int = 3, letter: str = "[\u3400-\u4dbf\u4e00-\u9fff]") -> DataFrame:
    """Of each missing term and row, the k n-grams of like length that are nearest to it; a candidate has a character that fits ``letter``."""
    fits = re.compile(letter)

    @F.pandas_udf("array<struct<word:string,score:double>>")
    def nearest(term: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([[{"word": x, "score": y} for x, y in nearest_grams(a or "", b or "", k, fits)] for a, b in zip(term, text, strict=True)], dtype=object)

    pairs = rows.select(key, "text").crossJoin(F.broadcast(terms.select("term")))  # each text is searched for each term
    found = pairs.select(key, "term", F.posexplode(nearest("term", "text")).alias("at", "x"))
    return found.select(key, "term", "x.word", "x.score", (F.col("at") + 1).alias("place"))
