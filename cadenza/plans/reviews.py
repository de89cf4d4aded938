"""Queries that choose labellings, list what to review, and decide on recovered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import intervals as iv
from cadenza.operators import review as rv
from cadenza.operators import runs as rn
from cadenza.plans.registry import query
from cadenza.plans.relations import _MIX, _pitch
from cadenza.plans.timeline import _FLAGS, _SUMMARY, _runs
from cadenza.sources.adapters import ranges, segments, table, turns


def _label(k: int) -> Column:
    return F.when(F.col("speaker").isNotNull(), F.concat(F.lit("S"), F.expr(f"length(speaker) % {k}")))


def _summary_sql(k: int) -> str:
    relabel = f"(SELECT * REPLACE (CASE WHEN speaker IS NOT NULL THEN 'S' || (length(speaker) % {k}) END AS speaker) FROM segments)"
    return _SUMMARY.replace("FROM segments", f"FROM {relabel}").replace("summary AS", f"summary{k} AS").replace("lab AS", f"lab{k} AS").replace("FROM lab ", f"FROM lab{k} ")


def _weak() -> str:
    return "stable_turns <= 2 OR duration_ratio <= 0.06 OR segment_ratio <= 0.06"


@query(
    f"""WITH {_SUMMARY}, wk AS (SELECT rec_id, speaker FROM summary WHERE {_weak()}),
    {_runs(1.5).replace("lab AS", "lab2 AS").replace("FROM lab ", "FROM lab2 ").replace(" b AS", " b2 AS").replace("FROM b)", "FROM b2)").replace(" g AS (", " g2 AS (").replace("FROM g GROUP", "FROM g2 GROUP").replace("runs AS", "runs2 AS")},
    x AS (SELECT *, "end" - start AS d, lag(speaker) OVER w AS p, lead(speaker) OVER w AS q, lag("end" - start) OVER w AS dp, lead("end" - start) OVER w AS dq FROM runs2 WINDOW w AS (PARTITION BY rec_id ORDER BY run_idx))
    SELECT x.rec_id, first_idx, last_idx, x.speaker AS from_speaker, CASE WHEN p = q THEN p ELSE x.speaker END AS to_speaker FROM x JOIN wk ON x.rec_id = wk.rec_id AND x.speaker = wk.speaker
    WHERE x.speaker <> p AND x.speaker <> q AND dp >= 2 AND dq >= 2 AND (segments <= 2 OR d <= 8)"""
)
def rv_local_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.local_jumps(segments(spark, sf_dir), around=2.0)


@query(
    f"""WITH {_SUMMARY}, l AS (SELECT rec_id, speaker FROM summary QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY duration_ratio, segment_ratio, stable_turns, speaker) <= 3),
    f AS (SELECT s.rec_id, s.speaker, s.seg_idx, row_number() OVER (PARTITION BY s.rec_id, s.speaker ORDER BY s.seg_idx) AS place FROM segments s JOIN l ON s.rec_id = l.rec_id AND s.speaker = l.speaker)
    SELECT rec_id, speaker, seg_idx, CAST(place AS INTEGER) AS place FROM f WHERE place <= 4"""
)
def rv_low_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return rv.first_rows(s, rv.least_supported(rn.speaker_summary(s), 3), 4)


@query(
    f"""WITH {_MIX}, mx AS (SELECT rec_id, speaker FROM mix WHERE low_s > 0 AND high_s > 0), f AS (SELECT s.rec_id, s.speaker, s.seg_idx, row_number() OVER (PARTITION BY s.rec_id, s.speaker ORDER BY s.seg_idx) AS place
      FROM segments s JOIN mx ON s.rec_id = mx.rec_id AND s.speaker = mx.speaker) SELECT rec_id, speaker, seg_idx, CAST(place AS INTEGER) AS place FROM f WHERE place <= 4"""
)
def rv_voice_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.operators.vectors import voice_mix

    return rv.first_rows(segments(spark, sf_dir), voice_mix(_pitch(spark, sf_dir)).where("low_s > 0 AND high_s > 0"), 4)


@query()
def dz_sweep_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.candidates(segments(spark, sf_dir), (2, 3, 5), _label)


@query()
def dz_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.chosen(rv.candidates(segments(spark, sf_dir), (2, 3, 5), _label))


@query(
    f"""WITH {_SUMMARY}, cand AS (SELECT *, count(*) OVER (PARTITION BY rec_id) AS n, segments <= 2 OR duration_s < 20 OR turns > 12 AS m FROM summary WHERE rec_id % 3 = 0 OR speaker IN ('view', 'click', 'error'))
    SELECT rec_id, bool_or(m) AND (max(n) >= 4 OR (max(n) = 3 AND bool_or(m AND (duration_s < 18 OR segment_ratio < 0.04 OR (turns >= 5 AND short_ratio >= 0.55 AND filler_ratio >= 0.45))))) AS merge FROM cand GROUP BY 1"""
)
def dz_guard_auto_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings with all their speakers and, for two in three of them, with the three that are named."""
    s = rn.speaker_summary(segments(spark, sf_dir)).where("rec_id % 3 = 0 OR speaker IN ('view', 'click', 'error')")
    return rv.auto_merge(s.withColumn("mergeable", F.expr("segments <= 2 OR duration_s < 20 OR turns > 12")))


@query()
def dz_guard_minor_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    lower, higher = (rn.speaker_summary(s.withColumn("speaker", _label(k))) for k in (2, 3))
    return rv.minor_split(lower, higher)


_SPLIT = """lo AS (SELECT rec_id, seg_idx, 'S' || (length(speaker) % 2) AS parent, speaker AS child, "end" - start AS d FROM segments WHERE speaker IS NOT NULL),
    sp AS (SELECT rec_id, parent, child, count(*) AS rows, round(sum(d), 6) AS seconds FROM lo GROUP BY 1, 2, 3)"""


@query(f"WITH {_SPLIT} SELECT *, round(seconds / sum(seconds) OVER (PARTITION BY rec_id, parent), 6) AS share FROM sp")
def dz_split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return rv.splits(s.withColumn("speaker", _label(2)), s)


@query(f"WITH {_SPLIT} SELECT rec_id, child, parent, seconds FROM sp QUALIFY row_number() OVER (PARTITION BY rec_id, child ORDER BY seconds DESC, parent) = 1")
def dz_anchor_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return rv.merge_map(s.withColumn("speaker", _label(2)), s)


_ATTEMPTS = """att AS (SELECT event_id AS attempt, event_id // 8 AS "window", CASE WHEN event_id % 3 = 0 THEN 'independent' ELSE 'primary' END AS provider_kind, CASE WHEN event_id % 3 = 0 THEN 'f2' ELSE 'f1' END AS family,
    'w' || event_id % 4 AS framing, CASE WHEN event_id % 29 = 0 THEN '' ELSE 's' || event_id % 5 END AS slice, CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id // 8 % 3 = 0 THEN 'matched_existing' ELSE 'valid' END AS status,
    'v' || (event_id % 17) % 2 AS value, event_id % 13 = 0 AS risky FROM events)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS attempt",
        "event_id div 8 AS window",
        "CASE WHEN event_id % 3 = 0 THEN 'independent' ELSE 'primary' END AS provider_kind",
        "CASE WHEN event_id % 3 = 0 THEN 'f2' ELSE 'f1' END AS family",
        "concat('w', event_id % 4) AS framing",
        "CASE WHEN event_id % 29 = 0 THEN '' ELSE concat('s', event_id % 5) END AS slice",
        "CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id div 8 % 3 = 0 THEN 'matched_existing' ELSE 'valid' END AS status",
        "concat('v', (event_id % 17) % 2) AS value",
        "event_id % 13 = 0 AS risky",
    )


_STABLE = """la AS (SELECT "window", value, framing, arg_max(slice, attempt) AS slice FROM att WHERE status = '{s}' AND provider_kind = 'primary' AND NOT risky AND value <> '' GROUP BY 1, 2, 3),
    pe AS (SELECT "window", value, count(*) AS framings FROM la GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT slice) >= 2 AND bool_and(slice <> '')),
    st AS (SELECT * FROM pe QUALIFY row_number() OVER (PARTITION BY "window" ORDER BY framings DESC, value) = 1)"""
_INDEP = """ind_{s} AS (SELECT DISTINCT "window", value FROM att a WHERE status = '{s}' AND provider_kind = 'independent' AND NOT risky AND slice <> ''
    AND NOT EXISTS (SELECT 1 FROM att p WHERE p."window" = a."window" AND p.provider_kind = 'primary' AND p.family = a.family))"""


@query(f"WITH {_ATTEMPTS}, {_STABLE.format(s='valid')} SELECT * FROM st", timeline=False)
def co_recovery_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.stable_primary(_attempts(spark, sf_dir), "valid")


@query(f"WITH {_ATTEMPTS}, {_INDEP.format(s='valid')} SELECT * FROM ind_valid", timeline=False)
def co_recovery_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.independent(_attempts(spark, sf_dir), "valid")


@query(
    f"""WITH {_ATTEMPTS}, {_STABLE.format(s='valid')}, {_INDEP.format(s='valid')}, {_INDEP.format(s='matched_existing')},
    ex AS (SELECT i."window", min(i.value) AS v FROM ind_matched_existing i JOIN att a ON a."window" = i."window" AND a.value = i.value AND a.status = 'matched_existing' AND a.provider_kind = 'primary' AND a.slice <> '' GROUP BY 1),
    nw AS (SELECT st."window", st.value AS v FROM st JOIN ind_valid i ON i."window" = st."window" AND i.value = st.value WHERE length(st.value) >= 2), al AS (SELECT "window", bool_and(status = 'error') AS failed FROM att GROUP BY 1)
    SELECT al."window", CASE WHEN ex.v IS NOT NULL THEN 'matched_existing' WHEN nw.v IS NOT NULL THEN 'insert_accepted' WHEN failed THEN 'error' ELSE 'rejected' END AS decision, coalesce(ex.v, nw.v, '') AS value
    FROM al LEFT JOIN ex ON al."window" = ex."window" LEFT JOIN nw ON al."window" = nw."window" """,
    timeline=False,
)
def co_recovery_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.recovery(_attempts(spark, sf_dir))


@query(
    """WITH c AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'abab' || 'ab' ELSE event_type END AS n, CASE WHEN event_id % 4 = 0 THEN 'view click' WHEN event_id % 6 = 1 THEN 'zzz' ELSE '' END AS ref,
      left(event_type, event_id % 5) AS res, event_id % 9 = 0 AS risky FROM events),
    r AS (SELECT *, n <> '' AND contains(ref, n) AS hit, CASE WHEN n = '' THEN 'empty_candidate' WHEN contains(ref, n) THEN NULL WHEN ref <> '' THEN 'overlapping_reference_unresolved' WHEN n = 'ababab' THEN 'repeated_hallucination'
      WHEN risky THEN 'provider_hallucination_risk' WHEN length(res) < 2 THEN 'residual_too_short' END AS reason FROM c)
    SELECT event_id, CASE WHEN hit THEN 'matched_existing' WHEN reason IS NOT NULL THEN 'rejected' ELSE 'valid' END AS status, CASE WHEN NOT hit THEN reason END AS reason FROM r""",
    timeline=False,
)
def co_recovery_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.expr("CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'ababab' ELSE event_type END")
    ref = F.expr("CASE WHEN event_id % 4 = 0 THEN 'view click' WHEN event_id % 6 = 1 THEN 'zzz' ELSE '' END")
    status, reason = rv.attempt_status(n, ref, F.expr("left(event_type, CAST(event_id % 5 AS INT))"), 2, F.expr("event_id % 9 = 0"))
    return e.select("event_id", status.alias("status"), reason.alias("reason"))


@query("SELECT rec_id, seg_idx, CASE WHEN seg_idx % 3 = 0 THEN upper(text) ELSE text END AS text FROM segments")
def co_llm_batch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    answers = s.where("seg_idx % 3 <= 1").select("rec_id", "seg_idx", F.expr("CASE WHEN seg_idx % 3 = 0 THEN upper(text) ELSE ' ' END").alias("text"))
    return rv.llm_merge(s, answers)


@query(
    """WITH s AS (SELECT event_id, (event_id * 7 % 101) / 100 AS ab, (event_id * 11 % 101) / 100 AS ac, (event_id * 13 % 101) / 100 AS bc, (event_id * 17 % 101) / 100 AS lp FROM events)
    SELECT event_id, round(least(1.0, 0.62 * (1 - (ab + ac) / 2) + 0.25 * greatest(0, bc - (ab + ac) / 2) + 0.13 * lp), 6) AS score FROM s""",
    timeline=False,
)
def mt_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: F.expr(f"(event_id * {k} % 101) / 100")
    return table(spark, sf_dir, "events").select("event_id", F.round(rv.disagreement(of(7), of(11), of(13), of(17)), 6).alias("score"))


@query(
    """WITH r AS (SELECT rec_id, start, "end", max("end") OVER (PARTITION BY rec_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranges),
    g AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY start, "end") AS g FROM r), m AS (SELECT rec_id, min(start) AS start, max("end") AS "end" FROM g GROUP BY rec_id, g),
    x AS (SELECT s.rec_id, s.seg_idx, s."end" - s.start AS d, coalesce(sum(CASE WHEN m.start IS NOT NULL THEN least(s."end", m."end") - greatest(s.start, m.start) END), 0) AS x FROM segments s
      LEFT JOIN m ON s.rec_id = m.rec_id AND m.start < s."end" AND m."end" > s.start GROUP BY ALL) SELECT rec_id, seg_idx, round(x / d, 9) <= 0.02 AS clean FROM x"""
)
def flt_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = iv.overlap_ratio(segments(spark, sf_dir), ranges(spark, sf_dir), digits=9)
    return r.select("rec_id", "seg_idx", (F.col("overlap_ratio") <= 0.02).alias("clean"))


@query("SELECT rec_id, seg_idx, speaker IS NULL OR length(text) < 4 AS risk FROM segments")
def flt_strong_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array(F.when(F.col("speaker").isNull(), "no speaker"), F.when(F.length("text") < 4, "short"))
    return segments(spark, sf_dir).select("rec_id", "seg_idx", F.exists(reasons, lambda r: r.isNotNull()).alias("risk"))


@query("SELECT rec_id, role AS speaker, n, round(n / sum(n) OVER (PARTITION BY rec_id), 6) AS share FROM (SELECT conv_id AS rec_id, role, count(*) AS n FROM conversations GROUP BY 1, 2)", timeline=False)
def mt_vote_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    n = turns(spark, sf_dir).groupBy("rec_id", "speaker").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("rec_id")), 6))
