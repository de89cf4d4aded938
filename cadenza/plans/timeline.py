"""Queries over runs, turns, neighbours and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import intervals as iv
from cadenza.operators import runs as rn
from cadenza.plans.registry import query
from cadenza.sources.adapters import ranges, segments, turns

_LABELLED = "lab AS (SELECT * FROM segments WHERE speaker IS NOT NULL)"


def _runs(gap: float | None) -> str:
    broken = "lag(speaker) OVER w IS NULL OR lag(speaker) OVER w <> speaker" + (f' OR start - lag("end") OVER w > {gap}' if gap is not None else "")
    return f"""{_LABELLED},
        b AS (SELECT *, CASE WHEN {broken} THEN 1 ELSE 0 END AS b FROM lab WINDOW w AS (PARTITION BY rec_id ORDER BY seg_idx)),
        g AS (SELECT *, sum(b) OVER (PARTITION BY rec_id ORDER BY seg_idx) AS run_idx FROM b),
        runs AS (SELECT rec_id, CAST(run_idx AS BIGINT) AS run_idx, min(speaker) AS speaker, min(start) AS start, arg_max("end", seg_idx) AS "end", count(*) AS segments,
                 min(seg_idx) AS first_idx, max(seg_idx) AS last_idx FROM g GROUP BY rec_id, run_idx)"""


@query(f"WITH {_runs(1.5)} SELECT * FROM runs")
def win_speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.runs(segments(spark, sf_dir), 1.5)


@query(f'WITH {_runs(1.2)} SELECT rec_id, speaker, count(*) AS turns, count(*) FILTER ("end" - start >= 4 OR segments >= 3) AS stable_turns FROM runs GROUP BY 1, 2')
def win_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stable = F.expr("end - start >= 4 OR segments >= 3")
    return rn.runs(segments(spark, sf_dir), 1.2).groupBy("rec_id", "speaker").agg(F.count("*").alias("turns"), F.count_if(stable).alias("stable_turns"))


@query(
    f"""WITH {_LABELLED}, b AS (SELECT rec_id, seg_idx, speaker, regexp_replace(text, '\\s+', '', 'g') AS text FROM turns),
        c AS (SELECT *, CASE WHEN lag(speaker) OVER w IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS b FROM b WINDOW w AS (PARTITION BY rec_id ORDER BY seg_idx)),
        g AS (SELECT *, sum(b) OVER (PARTITION BY rec_id ORDER BY seg_idx) AS turn FROM c)
        SELECT rec_id, CAST(turn AS BIGINT) AS turn, min(speaker) AS speaker, string_agg(text, '' ORDER BY seg_idx) AS text FROM g GROUP BY rec_id, turn"""
)
def win_dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[ \t\n\r\f]+", "")).withColumn("start", F.lit(0.0)).withColumn("end", F.lit(0.0))
    g = rn.with_runs(t, None).groupBy("rec_id", F.col("run_idx").alias("turn"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), "")
    return g.agg(F.first("speaker").alias("speaker"), said.alias("text"))


_SUMMARY = f"""{_runs(1.2)},
    t AS (SELECT rec_id, speaker, count(*) AS turns, count(*) FILTER ("end" - start >= 4 OR segments >= 3) AS stable_turns FROM runs GROUP BY 1, 2),
    n AS (SELECT *, count(*) OVER (PARTITION BY rec_id) AS total, lag(speaker) OVER w AS p, lead(speaker) OVER w AS q FROM segments WINDOW w AS (PARTITION BY rec_id ORDER BY seg_idx)),
    a AS (SELECT rec_id, speaker, count(*) AS segments, max(total) AS total, sum("end" - start) AS d,
          count(*) FILTER ("end" - start < 1.5) AS short_segments, count(*) FILTER (regexp_full_match(trim(text), '[嗯啊呃哦对是好可以行的了哈\\s,，。.!！?？]+')) AS filler_segments,
          count(*) FILTER (p = q AND p <> speaker) AS sandwiched_segments FROM n WHERE speaker IS NOT NULL GROUP BY 1, 2),
    summary AS (SELECT a.rec_id, a.speaker, segments, round(segments / total, 6) AS segment_ratio, round(d, 6) AS duration_s, round(d / sum(d) OVER (PARTITION BY a.rec_id), 6) AS duration_ratio,
          turns, stable_turns, short_segments, round(short_segments / segments, 6) AS short_ratio, filler_segments, round(filler_segments / segments, 6) AS filler_ratio,
          sandwiched_segments, round(sandwiched_segments / segments, 6) AS sandwiched_ratio FROM a JOIN t ON a.rec_id = t.rec_id AND a.speaker = t.speaker)"""


@query(f"WITH {_SUMMARY} SELECT * FROM summary")
def agg_speaker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.speaker_summary(segments(spark, sf_dir))


_FLAGS = """flags AS (SELECT *, segments <= 2 OR duration_s < 3 OR (stable_turns = 0 AND segments < 6) AS tiny FROM summary),
    f2 AS (SELECT *, NOT tiny AND (segments < 8 OR duration_s < 10 OR stable_turns = 0 OR duration_s < 18) AS weak,
           NOT tiny AND turns >= 5 AND ((duration_s / turns < 3 AND stable_turns <= 3) OR (short_ratio >= 0.45 AND filler_ratio >= 0.35)
             OR (sandwiched_ratio >= 0.18 AND filler_ratio >= 0.3) OR (duration_s < 18 AND short_ratio >= 0.35)) AS fragmented,
           NOT tiny AND (segment_ratio < 0.015 OR duration_ratio < 0.01) AS marginal FROM flags),
    per AS (SELECT rec_id, count(*) AS formed, max(segment_ratio) AS dominant, count(*) FILTER (NOT tiny AND NOT weak AND NOT fragmented) AS stable,
            count(*) FILTER (weak) AS weak, count(*) FILTER (tiny) AS tiny, count(*) FILTER (fragmented) AS fragmented, count(*) FILTER (marginal) AS marginal FROM f2 GROUP BY 1),
    scored AS (SELECT rec_id, 5 AS requested, formed, stable, weak, tiny, fragmented, marginal, round(6 * stable + 0.5 * weak - 6 * tiny - 4 * fragmented - 2.5 * marginal
            - CASE WHEN dominant > 0.82 THEN (dominant - 0.82) * 12 ELSE 0 END - (weak + tiny) * 1.5 - greatest(0, 5 - formed) * 2.0 - greatest(0, 5 - stable) * 0.8
            + CASE WHEN stable >= 2 THEN 1 ELSE 0 END + CASE WHEN stable = 5 THEN 2 ELSE 0 END - CASE WHEN stable = 0 THEN 8 ELSE 0 END, 4) AS score FROM per)"""


@query(f"WITH {_SUMMARY}, {_FLAGS} SELECT * REPLACE (CAST(score AS DOUBLE) AS score) FROM scored")
def dz_score_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.score_candidates(rn.speaker_summary(segments(spark, sf_dir)), 5)


@query(
    f"""WITH {_runs(None)},
    m AS (SELECT rec_id, max("end") - min(start) AS span, count(*) FILTER (speaker IS NULL) AS missing, count(*) FILTER (speaker IS NOT NULL) AS n,
          coalesce(sum("end" - start) FILTER (speaker IS NOT NULL), 0) AS total, count(*) FILTER (speaker IS NOT NULL AND "end" - start < 1) AS short_segments,
          count(*) FILTER (speaker IS NOT NULL AND "end" - start < 0.5) AS fragment_segments FROM segments GROUP BY 1),
    t AS (SELECT rec_id, count(*) AS turns FROM runs GROUP BY 1),
    k AS (SELECT rec_id, max(d) AS top, count(*) AS speakers FROM (SELECT rec_id, speaker, sum("end" - start) AS d FROM lab GROUP BY 1, 2) GROUP BY 1),
    r AS (SELECT m.*, coalesce(turns, 0) AS turns, greatest(0, coalesce(turns, 0) - 1) AS sw, short_segments / greatest(1, n) AS sr, fragment_segments / greatest(1, n) AS fr,
          coalesce(speakers, 0) AS speakers, CASE WHEN total > 0 THEN top / total ELSE 0 END AS dom FROM m LEFT JOIN t ON m.rec_id = t.rec_id LEFT JOIN k ON m.rec_id = k.rec_id),
    q AS (SELECT *, CASE WHEN span > 0 THEN sw / (span / 60) ELSE 0 END AS rate FROM r)
    SELECT rec_id, turns, sw AS speaker_switches, round(total / greatest(1, n), 6) AS avg_segment_s, short_segments, round(sr, 6) AS short_ratio, fragment_segments,
      round(fr, 6) AS fragment_ratio, round(rate, 6) AS switch_rate_per_min, round(dom, 6) AS dominant_ratio, missing AS missing_speaker_segments,
      CASE WHEN fr >= 0.25 OR sr >= 0.55 OR rate >= 20 THEN 'high' WHEN fr >= 0.12 OR sr >= 0.35 OR rate >= 12 OR (speakers >= 2 AND dom >= 0.92) THEN 'medium' ELSE 'low' END AS proxy_risk FROM q"""
)
def agg_proxy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.proxy_metrics(segments(spark, sf_dir))


@query(
    f"""WITH {_LABELLED}, n AS (SELECT *, lag(speaker) OVER (PARTITION BY rec_id ORDER BY seg_idx) AS p FROM lab)
    SELECT rec_id, start AS time, p AS from_speaker, speaker AS to_speaker FROM n WHERE p <> speaker"""
)
def win_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.change_points(segments(spark, sf_dir))


@query(
    """WITH n AS (SELECT *, lag(speaker) OVER w AS p, lead(speaker) OVER w AS q FROM segments WINDOW w AS (PARTITION BY rec_id ORDER BY seg_idx))
    SELECT rec_id, seg_idx, speaker, p AS around FROM n WHERE p = q AND p <> speaker"""
)
def win_sandwich(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    rows = s.withColumn("hit", rn.sandwiched(s)).withColumn("around", F.lag("speaker").over(rn.order()))
    return rows.where("hit").select("rec_id", "seg_idx", "speaker", "around")


@query(
    """WITH s AS (SELECT * REPLACE (coalesce(speaker, '') AS speaker) FROM segments),
    b AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND start - lag("end") OVER w <= 1.2 THEN 0 ELSE 1 END AS b FROM s WINDOW w AS (PARTITION BY rec_id ORDER BY seg_idx)),
    g AS (SELECT *, sum(b) OVER (PARTITION BY rec_id ORDER BY seg_idx) AS g FROM b), c AS (SELECT *, count(*) OVER (PARTITION BY rec_id, g) AS run_length FROM g)
    SELECT rec_id, seg_idx, speaker, run_length FROM c WHERE speaker <> ''"""
)
def win_same_run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.run_lengths(segments(spark, sf_dir).withColumn("speaker", F.coalesce("speaker", F.lit(""))))


@query(
    f"""WITH {_LABELLED}, p AS (SELECT a.rec_id, a.seg_idx, min(greatest(0, CASE WHEN b.start >= a."end" THEN b.start - a."end" WHEN a.start >= b."end" THEN a.start - b."end" ELSE 0 END)) AS gap
      FROM lab a JOIN lab b ON a.rec_id = b.rec_id AND a.speaker = b.speaker AND a.seg_idx <> b.seg_idx GROUP BY 1, 2)
    SELECT l.rec_id, l.seg_idx, CASE WHEN gap <= 18 THEN round(gap, 6) END AS gap FROM lab l LEFT JOIN p ON l.rec_id = p.rec_id AND l.seg_idx = p.seg_idx"""
)
def win_nearest_same_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.nearest_same_gap(segments(spark, sf_dir))


@query(
    """WITH a AS (SELECT rec_id, seg_idx, list(text) OVER (PARTITION BY rec_id ORDER BY seg_idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b,
      list(text) OVER (PARTITION BY rec_id ORDER BY seg_idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS c FROM turns)
    SELECT rec_id, seg_idx, coalesce(array_to_string(b, ' / '), '') AS before, coalesce(array_to_string(c, ' / '), '') AS after FROM a"""
)
def join_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.context(turns(spark, sf_dir), 2)


@query("""SELECT rec_id, seg_idx, last_value(speaker IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS speaker FROM segments""")
def win_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.carry_forward(segments(spark, sf_dir), "speaker").select("rec_id", "seg_idx", "speaker")


@query(f"""WITH {_LABELLED} SELECT rec_id, speaker, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY min(seg_idx)) AS INTEGER) AS place FROM lab GROUP BY 1, 2""")
def win_first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.first_appearance(segments(spark, sf_dir))


@query(f"""WITH {_LABELLED} SELECT rec_id, speaker, 'S' || row_number() OVER (PARTITION BY rec_id ORDER BY min(seg_idx)) AS display FROM lab GROUP BY 1, 2 QUALIFY speaker <> 'error'""")
def join_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = rn.first_appearance(segments(spark, sf_dir)).withColumn("display", F.concat(F.lit("S"), "place"))
    reserved = spark.createDataFrame([("error",)], "speaker string")
    return named.join(reserved, "speaker", "left_anti").select("rec_id", "speaker", "display")


@query("""SELECT rec_id, seg_idx, CAST((row_number() OVER (PARTITION BY rec_id ORDER BY seg_idx) - 1) // 3 AS INTEGER) AS batch FROM turns""")
def win_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.batches(turns(spark, sf_dir), 3).select("rec_id", "seg_idx", "batch")


@query(
    """WITH n AS (SELECT rec_id, seg_idx, speaker, lag(speaker) OVER (PARTITION BY rec_id ORDER BY seg_idx) AS p FROM turns)
    SELECT rec_id, string_agg(speaker, '>' ORDER BY seg_idx) AS sequence FROM n WHERE p IS DISTINCT FROM speaker GROUP BY 1"""
)
def win_label_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("p", F.lag("speaker").over(rn.order())).where("NOT (p <=> speaker)")
    one = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "speaker"))), lambda x: x["speaker"])
    return t.groupBy("rec_id").agg(F.array_join(one, ">").alias("sequence"))


_MERGED = """SELECT rec_id, start, "end", max("end") OVER (PARTITION BY rec_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}"""


def _islands(src: str, tolerance: float, name: str) -> str:
    return f"""{name}_r AS ({_MERGED.format(src=src)}), {name}_g AS (SELECT *, sum(CASE WHEN start <= reach + {tolerance} THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY start, "end") AS g FROM {name}_r),
    {name} AS (SELECT rec_id, min(start) AS start, max("end") AS "end", count(*) AS n FROM {name}_g GROUP BY rec_id, g)"""


@query(f"WITH {_islands('ranges', 0.05, 'm')} SELECT * FROM m")
def win_group_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.merge_windows(ranges(spark, sf_dir), 0.05)


@query(
    f"""WITH {_LABELLED}, f AS (SELECT *, coalesce(CAST(speaker <> lag(speaker) OVER (PARTITION BY rec_id ORDER BY seg_idx) AS INTEGER), 0) AS flip FROM lab),
    w AS (SELECT a.rec_id, a.seg_idx, count(*) AS rows, sum(b.flip) - max(a.flip) AS switches, count(DISTINCT b.speaker) AS speakers
          FROM f a JOIN f b ON a.rec_id = b.rec_id AND b.start >= a.start AND b.start <= a.start + 8 + 1e-6 GROUP BY 1, 2)
    SELECT rec_id, seg_idx, rows, CAST(switches AS BIGINT) AS switches, CAST(speakers AS INTEGER) AS speakers FROM w WHERE rows >= 4 AND speakers = 2 AND switches >= 2"""
)
def win_rapid_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.rapid_alternation(segments(spark, sf_dir), 8.0, 4, 2)


@query(
    f"""WITH {_runs(None)}, n AS (SELECT *, "end" - start AS d, lag(speaker) OVER w AS p, lead(speaker) OVER w AS q, lag("end" - start) OVER w AS dp, lead("end" - start) OVER w AS dq
      FROM runs WINDOW w AS (PARTITION BY rec_id ORDER BY run_idx))
    SELECT rec_id, first_idx, last_idx, speaker AS from_speaker, p AS to_speaker FROM n WHERE p = q AND segments <= 3 AND d BETWEEN 1 AND 25 AND dp >= 2 AND dq >= 2"""
)
def dz_smooth_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.smooth_sandwiched(segments(spark, sf_dir), around=2.0)


# Intervals


@query(f"WITH {_islands('ranges', 0, 'm')} SELECT rec_id, start, \"end\" FROM m")
def iv_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.merged(ranges(spark, sf_dir))


@query(f"""WITH c AS (SELECT rec_id, least(greatest(0, start - 0.5), 60) AS start, least("end" + 0.5, 60) AS "end" FROM ranges), d AS (SELECT * FROM c WHERE "end" > start), {_islands('d', 0, 'm')} SELECT rec_id, start, "end" FROM m""")
def iv_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.normalized(ranges(spark, sf_dir), 0.5, 60.0)


@query(f"""WITH {_islands('ranges', 0, 'm')} SELECT rec_id, round(sum("end" - start), 6) AS seconds FROM m GROUP BY 1""")
def iv_union_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.union_duration(ranges(spark, sf_dir))


_GAPS = """pts AS (SELECT rec_id, start AS t FROM sp UNION SELECT rec_id, "end" FROM sp UNION SELECT rec_id, start FROM cv UNION SELECT rec_id, "end" FROM cv),
    el AS (SELECT rec_id, t AS start, lead(t) OVER (PARTITION BY rec_id ORDER BY t) AS "end" FROM pts),
    un AS (SELECT * FROM el WHERE "end" > start AND EXISTS (SELECT 1 FROM sp WHERE sp.rec_id = el.rec_id AND sp.start <= el.start AND sp."end" >= el."end")
           AND NOT EXISTS (SELECT 1 FROM cv WHERE cv.rec_id = el.rec_id AND cv.start <= el.start AND cv."end" >= el."end"))"""


@query(
    f"""WITH {_islands('segments', 0, 'sp')}, {_islands('ranges', 0, 'cv')}, {_GAPS}, {_islands('un', 0, 'm')} SELECT rec_id, start, "end" FROM m"""
)
def iv_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.subtracted(segments(spark, sf_dir), ranges(spark, sf_dir))


@query(
    f"""WITH {_islands('ranges', 0, 'sp')}, cw AS (SELECT rec_id, greatest(0, start + 0.3 - 0.1) AS start, "end" - 0.1 + 0.1 AS "end" FROM segments WHERE "end" - 0.1 > start + 0.3), {_islands('cw', 0, 'cv')}, {_GAPS}, {_islands('un', 0, 'm')},
    t AS (SELECT rec_id, count(*) AS k, sum("end" - start) AS speech, min(start) AS s0, max("end") AS s1 FROM sp GROUP BY 1),
    l AS (SELECT rec_id, sum("end" - start) AS lost, max("end" - start) AS most, min(start) AS f, arg_min("end" - start, start) AS fd, max("end") AS z, arg_max("end" - start, "end") AS zd FROM m GROUP BY 1)
    SELECT t.rec_id, k AS speech_ranges, round(speech, 3) AS speech_duration_s, round(greatest(0, speech - coalesce(lost, 0)), 3) AS covered_speech_s, round(coalesce(lost, 0), 3) AS uncovered_speech_s,
      round((speech - coalesce(lost, 0)) / speech, 6) AS speech_coverage_ratio, round(coalesce(most, 0), 3) AS max_uncovered_speech_s,
      round(CASE WHEN abs(f - s0) <= 0.001 THEN fd ELSE 0 END, 3) AS leading_uncovered_speech_s, round(CASE WHEN abs(z - s1) <= 0.001 THEN zd ELSE 0 END, 3) AS trailing_uncovered_speech_s
    FROM t LEFT JOIN l ON t.rec_id = l.rec_id"""
)
def agg_speech_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = segments(spark, sf_dir).withColumn("start", F.col("start") + 0.3).withColumn("end", F.col("end") - 0.1).where("end > start")
    return iv.speech_coverage(ranges(spark, sf_dir), said, 0.1)


@query(
    f"""WITH {_islands('ranges', 0, 'm')}, y AS (SELECT s.rec_id, s.seg_idx, s.start, s."end", coalesce(sum(CASE WHEN m.start IS NOT NULL THEN least(s."end", m."end") - greatest(s.start, m.start) END), 0) AS x
      FROM segments s LEFT JOIN m ON s.rec_id = m.rec_id AND m.start < s."end" AND m."end" > s.start GROUP BY ALL)
    SELECT rec_id, seg_idx, round(least(1, x / ("end" - start)), 9) AS overlap_ratio, x >= 0.12 - 1e-9 AND x / ("end" - start) >= 0.08 AS speaker_overlap_risk FROM y"""
)
def iv_map_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.overlap_ratio(segments(spark, sf_dir), ranges(spark, sf_dir), digits=9)


@query(
    f"""WITH {_islands('ranges', 0, 'm')} SELECT s.rec_id, s.seg_idx, greatest(s.start, m.start) AS start, least(s."end", m."end") AS "end"
    FROM segments s JOIN m ON s.rec_id = m.rec_id AND m.start < s."end" AND m."end" > s.start"""
)
def iv_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = iv.overlap_join(segments(spark, sf_dir).select("rec_id", "seg_idx", "start", "end"), iv.merged(ranges(spark, sf_dir)))
    return pairs.select("rec_id", "seg_idx", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))


@query(
    """SELECT a.rec_id, a.seg_idx, b.seg_idx AS other, round(least(a."end", b."end") - greatest(a.start, b.start), 6) AS seconds
    FROM segments a JOIN segments b ON a.rec_id = b.rec_id AND a.seg_idx < b.seg_idx AND a.start < b."end" AND b.start < a."end" """
)
def iv_pair_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("rec_id", "seg_idx", "start", "end")
    pairs = iv.overlap_join(s, s).where("seg_idx < r_seg_idx")
    return pairs.select("rec_id", "seg_idx", F.col("r_seg_idx").alias("other"), F.round(F.least("end", "r_end") - F.greatest("start", "r_start"), 6).alias("seconds"))


_OWN = """own_r AS (SELECT rec_id, speaker, side, start, "end", max("end") OVER (PARTITION BY rec_id, speaker, side ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM (SELECT rec_id, speaker, 'ref' AS side, start, "end" FROM segments WHERE speaker IS NOT NULL UNION ALL SELECT rec_id, predicted, 'pred', start + 0.25, "end" + 0.25 FROM segments)),
    own_g AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id, speaker, side ORDER BY start, "end") AS g FROM own_r),
    own AS (SELECT rec_id, speaker, side, min(start) AS start, max("end") AS "end" FROM own_g GROUP BY rec_id, speaker, side, g),
    pts AS (SELECT rec_id, start AS t FROM own UNION SELECT rec_id, "end" FROM own), el0 AS (SELECT rec_id, t AS start, lead(t) OVER (PARTITION BY rec_id ORDER BY t) AS "end" FROM pts),
    act AS (SELECT el0.rec_id, el0.start, el0."end", coalesce(list_sort(list(DISTINCT speaker) FILTER (side = 'ref')), []) AS ref, coalesce(list_sort(list(DISTINCT speaker) FILTER (side = 'pred')), []) AS pred
      FROM el0 JOIN own ON own.rec_id = el0.rec_id AND own.start <= el0.start AND own."end" >= el0."end" WHERE el0."end" - el0.start > 1e-9 GROUP BY 1, 2, 3)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = segments(spark, sf_dir)
    return s, s.select("rec_id", F.col("predicted").alias("speaker"), (F.col("start") + 0.25).alias("start"), (F.col("end") + 0.25).alias("end"))


@query(f"""WITH {_OWN} SELECT rec_id, start, "end", array_to_string(ref, '+') AS ref, array_to_string(pred, '+') AS pred FROM act""")
def iv_active_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = iv.active_sets(*_sides(spark, sf_dir))
    return a.select("rec_id", "start", "end", F.array_join("ref", "+").alias("ref"), F.array_join("pred", "+").alias("pred"))


@query(
    f"""WITH {_OWN} SELECT rec_id, round(sum(len(ref) * ("end" - start)), 6) AS reference_s, round(sum(greatest(0, len(ref) - len(pred)) * ("end" - start)), 6) AS miss_s,
    round(sum(greatest(0, len(pred) - len(ref)) * ("end" - start)), 6) AS false_alarm_s, round(sum(least(len(ref), len(pred)) * ("end" - start)), 6) AS matchable_s FROM act GROUP BY 1"""
)
def agg_der_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.error_parts(iv.active_sets(*_sides(spark, sf_dir)))


@query(
    f"""WITH {_OWN} SELECT rec_id, round(sum(len(ref) * ("end" - start)), 6) AS reference_s, round(sum(greatest(0, len(ref) - len(pred)) * ("end" - start)), 6) AS miss_s,
    round(sum(greatest(0, len(pred) - len(ref)) * ("end" - start)), 6) AS false_alarm_s, round(sum(least(len(ref), len(pred)) * ("end" - start)), 6) AS matchable_s FROM act WHERE len(ref) >= 2 GROUP BY 1"""
)
def agg_overlap_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.error_parts(iv.active_sets(*_sides(spark, sf_dir)).where("size(ref) >= 2"))


@query(
    f"""WITH {_OWN}, a AS (SELECT rec_id, "end" - start AS d, unnest(pred) AS pred, ref FROM act), b AS (SELECT rec_id, d, pred, unnest(ref) AS ref FROM a)
    SELECT rec_id, pred, ref, round(sum(d), 6) AS seconds FROM b GROUP BY ALL"""
)
def iv_pair_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.pair_seconds(iv.active_sets(*_sides(spark, sf_dir)))


@query(
    f"""WITH {_OWN}, r AS (SELECT rec_id, start, "end" FROM act WHERE len(ref) >= 2) SELECT rec_id, round(coalesce(sum("end" - start) FILTER (len(ref) >= 2), 0), 6) AS seconds FROM act WHERE len(ref) > 0 GROUP BY 1"""
)
def iv_multi_active_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.multi_active(segments(spark, sf_dir))


@query(
    """WITH f AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, (event_id * 37 % 101) / 100 AS score FROM events),
    v AS (SELECT *, CASE WHEN score >= 0.55 THEN 1 WHEN score < 0.45 THEN 0 END AS ev FROM f),
    o AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS on_ FROM v),
    p AS (SELECT *, coalesce(lag(on_) OVER (PARTITION BY rec_id ORDER BY frame), 0) AS was FROM o),
    g AS (SELECT *, sum(CASE WHEN on_ <> was THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY frame) AS g FROM p),
    r AS (SELECT rec_id, min(frame) * 0.1 AS start, (max(frame) + 1) * 0.1 AS "end" FROM g WHERE on_ = 1 GROUP BY rec_id, g HAVING (max(frame) + 1) * 0.1 - min(frame) * 0.1 >= 0.2 - 1e-9),
    """
    + _islands("r", 0.1 + 1e-9, "m")
    + """ SELECT rec_id, round(CAST(start AS DOUBLE), 6) AS start, round(CAST("end" AS DOUBLE), 6) AS "end" FROM m"""
)
def win_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = segments(spark, sf_dir).select("rec_id", F.col("seg_idx").alias("frame"), F.expr("(event_id * 37 % 101) / 100").alias("score"))
    found = iv.hysteresis(frames, 0.55, 0.45, 0.1, 0.2, 0.1)
    return found.select("rec_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))
