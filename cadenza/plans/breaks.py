"""Queries over places where texts break, second speakers of overlaps, and cues around changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import breaks
from cadenza.operators import overlaps
from cadenza.operators import runs as rn
from cadenza.plans.registry import query
from cadenza.sources.adapters import segments, table


def _folded(marks: str, least: int, most: int) -> str:
    """SQL: the places at which a walk over a text's characters, with the end of the last piece, breaks."""
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS s FROM conversations),
    w AS (SELECT *, list_reduce(list_prepend([]::INTEGER[], list_transform(range(1, length(s) + 1), lambda x: [x::INTEGER])), lambda a, e: CASE WHEN (contains('{marks}', s[e[1]]) AND e[1] - coalesce(a[-1], 0) >= {least}) OR e[1] - coalesce(a[-1], 0) >= {most} THEN list_append(a, e[1]) ELSE a END) AS b FROM t)
    SELECT conv_id, turn, array_to_string(CASE WHEN len(b) = 0 OR b[-1] < length(s) THEN list_append(b, length(s)::INTEGER) ELSE b END, ',') AS breaks FROM w"""


def _said(spark: SparkSession, sf_dir: str, ends) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(ends("text"), ",").alias("breaks"))


@query(_folded("。！？!?；;' || chr(10) || '", 1, 80), timeline=False)
def str_break_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, breaks.sentence_breaks)


@query(_folded("，。！？；：、,.!?;:", 3, 12), timeline=False)
def str_break_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, breaks.cue_breaks)


@query(
    """WITH r AS (SELECT conv_id, turn, text AS s, length(text) AS n, CAST(round_even(length(text) * greatest(0.15, least(0.85, turn % 10 / 10)), 0) AS INTEGER) AS rough FROM conversations WHERE text IS NOT NULL),
    c AS (SELECT conv_id, turn, s, n, rough, unnest(range(0, n + 1)) AS i FROM r),
    m AS (SELECT conv_id, turn, arg_min(i, (abs(i - rough), i)) AS "at" FROM c WHERE i >= greatest(4, rough - 12) AND i <= least(n - 4, rough + 12) AND contains('。！？!?；;，,', s[i]) GROUP BY 1, 2),
    p AS (SELECT r.*, regexp_replace(left(s, coalesce(m."at", rough)), '^\\s+|\\s+$', '', 'g') AS a, regexp_replace(substr(s, coalesce(m."at", rough) + 1), '^\\s+|\\s+$', '', 'g') AS b FROM r LEFT JOIN m ON r.conv_id = m.conv_id AND r.turn = m.turn)
    SELECT conv_id, turn, a AS "left", b AS "right" FROM p WHERE rough > 0 AND rough < n AND length(a) >= 4 AND length(b) >= 4""",
    timeline=False,
)
def str_split_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("share", F.expr("turn % 10 / 10"))
    return t.select("conv_id", "turn", breaks.split_by_share("text", "share").alias("x")).where("x IS NOT NULL").select("conv_id", "turn", "x.left", "x.right")


@query(
    """WITH o AS (SELECT rec_id, greatest(0, start - 0.5) AS start, "end" AS "end", (event_id % 10) / 10 AS conf FROM segments WHERE (event_id % 10) / 10 >= 0.55),
    t AS (SELECT rec_id, start, "end", speaker FROM segments WHERE speaker IS NOT NULL), v AS (SELECT rec_id, start, "end", predicted AS speaker FROM segments),
    p AS (SELECT o.rec_id, greatest(o.start, t.start) AS a, least(o."end", t."end") AS b, speaker AS p, max(conf) AS conf FROM o JOIN t ON o.rec_id = t.rec_id AND o.start < t."end" AND o."end" > t.start WHERE round(least(o."end", t."end") - greatest(o.start, t.start), 9) >= 0.12 GROUP BY 1, 2, 3, 4),
    h AS (SELECT p.rec_id, a, b, p, speaker AS s, sum(least(b, "end") - greatest(a, start)) AS d FROM p JOIN v ON p.rec_id = v.rec_id AND v.start < b AND v."end" > a GROUP BY 1, 2, 3, 4, 5),
    hs AS (SELECT *, d / sum(d) OVER (PARTITION BY rec_id, a, b, p) AS w FROM h),
    g AS (SELECT p.rec_id, a, b, p, speaker AS s, min(greatest(0, start - b, a - "end")) AS gap FROM p JOIN t ON p.rec_id = t.rec_id GROUP BY 1, 2, 3, 4, 5),
    c AS (SELECT rec_id, a, b, p, s, round(coalesce(w, 0), 9) AS w, round(CASE WHEN gap <= 12 THEN exp(-gap / 3) ELSE 0 END, 9) AS x FROM g FULL JOIN hs USING (rec_id, a, b, p, s)),
    k AS (SELECT *, round(w + 0.35 * coalesce(x, 0), 9) AS sc FROM c WHERE s <> p AND greatest(w, coalesce(x, 0)) >= 0.05),
    r AS (SELECT *, row_number() OVER (PARTITION BY rec_id, a, b, p ORDER BY sc DESC, w DESC, x DESC, s DESC) AS i FROM k)
    SELECT rec_id, a AS start, b AS "end", p AS "primary", s AS "second", round(conf, 4) AS confidence, round(w, 4) AS share, round(coalesce(x, 0), 4) AS context, round(sc, 4) AS score FROM r JOIN p USING (rec_id, a, b, p) WHERE i = 1"""
)
def iv_overlap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    wide = s.select("rec_id", F.expr("greatest(0, start - 0.5)").alias("start"), "end", F.expr("event_id % 10 / 10").alias("confidence"))
    return overlaps.second_speakers(wide, s.where("speaker IS NOT NULL"), s.select("rec_id", "start", "end", F.col("predicted").alias("speaker")))


@query(
    """WITH q AS (SELECT rec_id, seg_idx, start, "end", row_number() OVER (PARTITION BY rec_id ORDER BY seg_idx) AS n FROM segments),
    l AS (SELECT *, lag(speaker) OVER (PARTITION BY rec_id ORDER BY seg_idx) AS p FROM segments WHERE speaker IS NOT NULL),
    h AS (SELECT DISTINCT rec_id, round(start + (seg_idx % 4 - 1) * 0.9, 3) AS t FROM l WHERE p <> speaker),
    f AS (SELECT h.rec_id, t, arg_min(n, (CASE WHEN start <= t AND t <= "end" THEN -1 ELSE round(abs((start + "end") / 2 - t), 9) END, n)) AS m FROM h JOIN q ON h.rec_id = q.rec_id GROUP BY 1, 2),
    x AS (SELECT f.rec_id, t, m, n, seg_idx, start, "end", n > m + 1 AND round(start - t, 9) > 1.5 AS far FROM f JOIN q ON f.rec_id = q.rec_id AND n >= m - 1 AND n <= m + 3),
    d AS (SELECT DISTINCT rec_id, seg_idx, start, "end" FROM x WHERE NOT EXISTS (SELECT 1 FROM x AS y WHERE y.rec_id = x.rec_id AND y.t = x.t AND y.far AND y.n <= x.n)),
    w AS (SELECT rec_id, seg_idx, CASE WHEN round("end" - start, 9) >= 1.5 THEN greatest(start, least("end" - 1.5, (start + "end") / 2 - 0.75)) END AS a FROM d)
    SELECT rec_id, seg_idx, round(a, 6) AS win_start, round(a + 1.5, 6) AS win_end FROM w"""
)
def iv_change_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    changes = rn.change_points(s).select("rec_id", F.col("time").alias("start"))
    moved = s.join(changes, ["rec_id", "start"]).select("rec_id", F.expr("round(start + (seg_idx % 4 - 1) * 0.9, 3)").alias("time"))
    return overlaps.near_changes(s, moved)
