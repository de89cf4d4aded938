"""Queries over two engines' labels, assignments by score, windows as text, and rounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.numbers import exact_round
from cadenza.operators import engines
from cadenza.plans.registry import query
from cadenza.sources.adapters import segments, table


@query(
    """WITH RECURSIVE z AS (SELECT rec_id, seg_idx, predicted AS s, speaker AS o FROM segments WHERE speaker IS NOT NULL),
    m AS (SELECT rec_id, s, o, count(*) AS n, min(seg_idx) AS f FROM z GROUP BY 1, 2, 3),
    l AS (SELECT rec_id, s, dense_rank() OVER (PARTITION BY rec_id ORDER BY f) AS k FROM (SELECT rec_id, s, min(f) AS f FROM m GROUP BY 1, 2)),
    c AS (SELECT rec_id, s, o, k, row_number() OVER (PARTITION BY rec_id, s ORDER BY n DESC, f) AS r FROM m JOIN l USING (rec_id, s)),
    g AS (SELECT DISTINCT rec_id, 0::BIGINT AS k, NULL::VARCHAR AS s, NULL::VARCHAR AS o, []::VARCHAR[] AS used FROM m
      UNION ALL SELECT rec_id, k, s, o, CASE WHEN o IS NULL THEN used ELSE list_append(used, o) END FROM (SELECT g.rec_id, c.k, c.s, g.used, arg_min(c.o, c.r) FILTER (NOT list_contains(g.used, c.o)) AS o FROM g JOIN c ON g.rec_id = c.rec_id AND c.k = g.k + 1 GROUP BY 1, 2, 3, 4) AS x)
    SELECT z.rec_id, z.seg_idx, z.s AS speaker, g.o AS mapped, z.o AS reference FROM z JOIN g ON z.rec_id = g.rec_id AND z.s = g.s WHERE g.o IS DISTINCT FROM z.o"""
)
def join_cross_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return engines.cross_engine(s.select("rec_id", "seg_idx", F.col("predicted").alias("speaker")), s.select("rec_id", "seg_idx", "speaker"))


@query(
    """WITH RECURSIVE w AS (SELECT rec_id, speaker AS s, predicted AS p, round(sum("end" - start) / 100, 6) AS w FROM segments WHERE speaker IS NOT NULL GROUP BY 1, 2, 3),
    v AS (SELECT *, dense_rank() OVER (PARTITION BY rec_id ORDER BY s) AS k FROM w WHERE w >= 0.02),
    n AS (SELECT DISTINCT rec_id, k, NULL::VARCHAR AS p, 0.0::DOUBLE AS w FROM v), o AS (SELECT rec_id, k, p, w FROM v UNION ALL SELECT rec_id, k, p, w FROM n),
    a AS (SELECT DISTINCT rec_id, 0::BIGINT AS k, []::VARCHAR[] AS used, 0.0::DOUBLE AS total FROM v
      UNION ALL SELECT a.rec_id, o.k, CASE WHEN o.p IS NULL THEN used ELSE list_append(used, o.p) END, total + o.w FROM a JOIN o ON a.rec_id = o.rec_id AND o.k = a.k + 1 AND (o.p IS NULL OR NOT list_contains(used, o.p)))
    SELECT rec_id, round(max(total), 4) AS total FROM a GROUP BY 1"""
)
def vec_bitmask_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, as ties leave several assignments."""
    scores = segments(spark, sf_dir).where("speaker IS NOT NULL").groupBy("rec_id", "speaker", F.col("predicted").alias("profile")).agg(F.round(F.sum(F.col("end") - F.col("start")) / 100, 6).alias("score"))
    return engines.profile_assignment(scores, 0.02).groupBy("rec_id").agg(F.round(F.sum("score"), 4).alias("total"))


_A, _B = "CAST(round(start * 1000) AS BIGINT)", 'CAST(round("end" * 1000) AS BIGINT)'


@query(
    f"""WITH k AS (SELECT rec_id, seg_idx, event_id % 6 AS k, {_A} AS a, {_B} AS b FROM segments)
    SELECT rec_id, seg_idx, CAST(a AS DOUBLE) AS start, CAST(b AS DOUBLE) AS "end", CASE k WHEN 1 THEN 'vad' WHEN 5 THEN 'gap' ELSE 'unknown' END AS reason FROM k WHERE k IN (0, 1, 5) AND b > a"""
)
def iv_cue_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as objects and arrays; those without length, number or end are dropped."""
    s = segments(spark, sf_dir).withColumn("a", F.expr(_A)).withColumn("b", F.expr(_B.replace('"', "`")))
    forms = ['{"start": %1$d, "end": %2$d}', '[%1$d, %2$d, "vad"]', '{"start": %1$d, "end": %1$d}', '{"start": "x", "end": %2$d}', "[%1$d]", ' {"start": "%1$d", "end": "%2$d", "reason": "gap"}']
    raw = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        raw = F.when(F.expr("event_id % 6") == i, F.format_string(form, "a", "b")).otherwise(raw)
    return s.withColumn("raw", raw).select("rec_id", "seg_idx", engines.window_bounds("raw").alias("x")).where("x IS NOT NULL").select("rec_id", "seg_idx", "x.*")


@query(
    """SELECT event_id, CAST(format('{:.1f}', value / 8) AS DOUBLE) AS r1, CAST(format('{:.2f}', value * 1.005::DOUBLE) AS DOUBLE) AS r2, CAST(format('{:.3f}', (CAST(event_id AS DOUBLE) + 0.5::DOUBLE) / 1000::DOUBLE) AS DOUBLE) AS r3 FROM events""",
    timeline=False,
)
def mt_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    r3 = exact_round((F.col("event_id").cast("double") + 0.5) / 1000, 3)
    return e.select("event_id", exact_round(F.col("value") / 8, 1).alias("r1"), exact_round(F.col("value") * 1.005, 2).alias("r2"), r3.alias("r3"))
