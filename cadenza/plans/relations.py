"""Queries over joins of segments with ranges, turns, windows and times, and over vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import joins as jn
from cadenza.operators import vectors as vc
from cadenza.plans.registry import query
from cadenza.sources.adapters import ranges, segments, table

#: Turns of another labelling: every segment, a little later.
_TURNS = 'tn AS (SELECT rec_id, start + 1.27 AS start, "end" + 1.27 AS "end", predicted AS speaker FROM segments)'


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("rec_id", (F.col("start") + 1.27).alias("start"), (F.col("end") + 1.27).alias("end"), F.col("predicted").alias("speaker"))


@query(
    f"""WITH {_TURNS}, o AS (SELECT c.rec_id, c.seg_idx, t.speaker AS s, round(sum(least(c."end", t."end") - greatest(c.start, t.start)), 6) AS o FROM segments c
      JOIN tn t ON c.rec_id = t.rec_id AND t.start < c."end" AND t."end" > c.start GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_idx ORDER BY o DESC, s DESC) AS r FROM o),
    l AS (SELECT c.rec_id, c.seg_idx, (c.start + c."end") / 2 AS m FROM segments c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.rec_id = c.rec_id AND o.seg_idx = c.seg_idx)),
    d AS (SELECT l.rec_id, l.seg_idx, t.speaker, t.start, t."end", least(abs(m - t.start), abs(m - t."end")) AS d FROM l JOIN tn t ON l.rec_id = t.rec_id),
    n AS (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_idx ORDER BY round(d, 9), start, "end", speaker) AS r FROM d)
    SELECT rec_id, seg_idx, s AS speaker, o AS seconds FROM b WHERE r = 1 UNION ALL SELECT rec_id, seg_idx, speaker, 0 FROM n WHERE r = 1"""
)
def join_overlap_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.overlap_argmax(segments(spark, sf_dir), _turns(spark, sf_dir))


@query(
    f"""WITH {_TURNS}, o AS (SELECT c.rec_id, c.seg_idx, c.start, c."end", t.speaker AS s, sum(least(c."end", t."end") - greatest(c.start, t.start)) AS o FROM segments c
      JOIN tn t ON c.rec_id = t.rec_id AND t.start < c."end" AND t."end" > c.start GROUP BY ALL),
    b AS (SELECT rec_id, seg_idx, start, "end", arg_max(s, (round(o, 6), s)) AS s, max(round(o, 6)) AS o, round(sum(o), 6) AS total FROM o GROUP BY 1, 2, 3, 4)
    SELECT rec_id, seg_idx, CASE WHEN round(o / total, 6) >= 0.45 OR o >= least(1.2, ("end" - start) * 0.35) THEN s END AS speaker, round(o / total, 6) AS purity FROM b"""
)
def join_overlap_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.overlap_vote(segments(spark, sf_dir), _turns(spark, sf_dir))


@query(
    """SELECT s.rec_id, s.seg_idx FROM segments s WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.rec_id = s.rec_id)
    OR EXISTS (SELECT 1 FROM ranges r WHERE r.rec_id = s.rec_id AND round((s.start + s."end") / 2, 6) >= r.start AND round((s.start + s."end") / 2, 6) <= r."end")"""
)
def flt_vad_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.in_ranges(segments(spark, sf_dir), ranges(spark, sf_dir)).select("rec_id", "seg_idx")


@query(
    """WITH q AS (SELECT rec_id, CAST(seg_idx * 2.5 + 0.01 AS DOUBLE) AS t FROM segments), c AS (SELECT q.rec_id, q.t, max(s.seg_idx) AS i FROM q JOIN segments s ON s.rec_id = q.rec_id AND s.start - 0.03 <= q.t GROUP BY 1, 2)
    SELECT q.rec_id, q.t, CASE WHEN q.t <= s."end" + 0.18 THEN s.seg_idx END AS seg_idx FROM q LEFT JOIN c ON q.rec_id = c.rec_id AND q.t = c.t LEFT JOIN segments s ON s.rec_id = c.rec_id AND s.seg_idx = c.i"""
)
def join_asof_active_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return jn.asof_segment(s.select("rec_id", F.expr("CAST(seg_idx * 2.5BD + 0.01BD AS DOUBLE)").alias("t")), s)


_WIN = "win AS (SELECT rec_id, seg_idx AS win, start - 1 AS start, \"end\" + 1 AS \"end\" FROM segments)"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return s.select("rec_id", F.col("seg_idx").alias("win"), (F.col("start") - 1).alias("start"), (F.col("end") + 1).alias("end"))


@query(
    f"""WITH {_WIN} SELECT w.rec_id, w.win, string_agg(s.text, '' ORDER BY s.seg_idx) AS text FROM win w JOIN segments s ON s.rec_id = w.rec_id AND s.start < w."end" + 0.25 AND s."end" > w.start - 0.25 GROUP BY 1, 2"""
)
def join_gold_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.gold_text(_windows(spark, sf_dir), segments(spark, sf_dir), 0.25)


@query(
    f"""WITH {_WIN}, p AS (SELECT w.rec_id, w.win, s.seg_idx, s.text, CASE WHEN s."end" <= w.start THEN 'l' WHEN s.start >= w."end" THEN 'r' ELSE 'i' END AS side
      FROM win w JOIN segments s ON s.rec_id = w.rec_id AND s.start < w."end" + 15 AND s."end" > w.start - 15)
    SELECT rec_id, win, coalesce(right(string_agg(text, '' ORDER BY seg_idx) FILTER (side = 'l'), 60), '') AS left_text, coalesce(string_agg(text, '' ORDER BY seg_idx) FILTER (side = 'i'), '') AS text,
      coalesce(left(string_agg(text, '' ORDER BY seg_idx) FILTER (side = 'r'), 60), '') AS right_text FROM p GROUP BY 1, 2"""
)
def join_local_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.local_reference(_windows(spark, sf_dir), segments(spark, sf_dir))


@query(f"""WITH {_WIN} SELECT s.rec_id, s.seg_idx, max(w.win) AS win FROM segments s JOIN win w ON s.rec_id = w.rec_id AND w.start < s."end" AND w."end" > s.start GROUP BY 1, 2""")
def join_disagreement_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.last_window(_windows(spark, sf_dir), segments(spark, sf_dir))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("rec_id", "seg_idx", F.col("predicted").alias("speaker"))


@query("SELECT rec_id, seg_idx, speaker AS from_speaker, predicted AS to_speaker FROM segments WHERE speaker IS DISTINCT FROM predicted")
def join_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.before_after(segments(spark, sf_dir), _predicted(spark, sf_dir))


@query("SELECT speaker, predicted AS other, count(*) AS n FROM segments WHERE speaker IS NOT NULL GROUP BY 1, 2")
def agg_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.agreement(segments(spark, sf_dir), _predicted(spark, sf_dir))


@query("SELECT s.rec_id, s.seg_idx, s.speaker, t.predicted FROM segments s JOIN segments t ON s.rec_id = t.rec_id AND s.seg_idx = t.seg_idx")
def join_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predicted(spark, sf_dir).withColumnRenamed("speaker", "predicted")
    return segments(spark, sf_dir).drop("predicted").join(p, ["rec_id", "seg_idx"]).select("rec_id", "seg_idx", "speaker", "predicted")


@query(
    """WITH n AS (SELECT *, lag("end") OVER w AS pe, lag(text) OVER w AS pt FROM segments WINDOW w AS (PARTITION BY rec_id ORDER BY seg_idx))
    SELECT rec_id, seg_idx, pt AS previous_text, text FROM n WHERE start - pe <= 0.8 AND length(text) <= 6"""
)
def join_boundary_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.operators.runs import order

    rows = segments(spark, sf_dir).withColumn("previous_text", F.lag("text").over(order())).withColumn("gap", F.col("start") - F.lag("end").over(order()))
    return rows.where("gap <= 0.8 AND length(text) <= 6").select("rec_id", "seg_idx", "previous_text", "text")


# Vectors

_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


def _dot(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


_UNIT = f"u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt({_dot('embedding', 'embedding')})) AS v FROM embeddings)"
_CENTROIDS = f"""{_UNIT}, e AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM u), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2),
    c0 AS (SELECT label, list(x ORDER BY i) AS m FROM m GROUP BY 1), c AS (SELECT label, list_transform(m, lambda x: x / sqrt({_dot('m', 'm')})) AS c FROM c0)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vc.centroids(_vectors(spark, sf_dir), "label", "embedding")


@query(f"WITH {_CENTROIDS} SELECT label, unnest(range(0, len(c))) AS i, round(unnest(c), 6) AS x FROM c", timeline=False)
def agg_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _centroids(spark, sf_dir).select("label", F.posexplode("centroid").alias("i", "x"))
    return rows.select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(
    f"""WITH {_CENTROIDS}, s AS (SELECT vec_id, c.label, round({_dot('v', 'c')}, 6) AS score FROM u, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM s)
    SELECT vec_id, label AS name, score FROM r WHERE r = 1""",
    timeline=False,
)
def vec_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vc.ranked(_vectors(spark, sf_dir), "vec_id", "embedding", _centroids(spark, sf_dir), "label", "centroid", 1)
    return ranks.select("vec_id", "name", "score")


@query(
    f"""WITH {_CENTROIDS}, s AS (SELECT vec_id, c.label, round({_dot('v', 'c')}, 6) AS score FROM u, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM s),
    t AS (SELECT vec_id, max(label) FILTER (r = 1) AS name, max(score) FILTER (r = 1) AS score, max(score) FILTER (r = 2) AS second FROM r WHERE r <= 2 GROUP BY 1)
    SELECT vec_id, name, score, round(score - coalesce(second, -1), 6) AS margin, CASE WHEN score >= 0.75 AND round(score - coalesce(second, -1), 6) >= 0.04 THEN 'assign' WHEN score >= 0.70 THEN 'review' ELSE 'reject' END AS decision FROM t""",
    timeline=False,
)
def vec_profile_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vc.matched(vc.ranked(_vectors(spark, sf_dir), "vec_id", "embedding", _centroids(spark, sf_dir), "label", "centroid"), "vec_id")


@query(
    f"""WITH {_UNIT}, p AS (SELECT a.label, round({_dot('a.v', 'b.v')}, 9) AS s FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id)
    SELECT label, count(*) AS pairs, round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.1), 6) AS p10, round(min(s), 6) AS least FROM p GROUP BY 1""",
    timeline=False,
)
def agg_embedding_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vc.consistency(_vectors(spark, sf_dir), "label", "vec_id", "embedding")


@query(f"WITH {_UNIT} SELECT vec_id, round({_dot('v', 'v')}, 6) AS squared, round(v[1], 6) AS first FROM u", timeline=False)
def mt_l2norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).select("vec_id", vc.unit("embedding").alias("v"))
    return v.select("vec_id", F.round(vc.dot("v", "v"), 6).alias("squared"), F.round(F.element_at("v", 1), 6).alias("first"))


@query(
    f"SELECT a.vec_id, b.vec_id AS other, round({_dot('a.embedding', 'b.embedding')} / sqrt({_dot('a.embedding', 'a.embedding')}) / sqrt({_dot('b.embedding', 'b.embedding')}), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    timeline=False,
)
def mt_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _vectors(spark, sf_dir).select("vec_id", F.col("embedding").alias("x"))
    b = _vectors(spark, sf_dir).select(F.col("vec_id").alias("other"), F.col("embedding").alias("y"))
    return a.join(b, F.col("other") == F.col("vec_id") + 1).select("vec_id", "other", F.round(vc.cosine("x", "y"), 6).alias("cosine"))


_PITCH = "vp AS (SELECT rec_id, speaker, \"end\" - start AS dur, 100 + (event_id * 31) % 140 AS pitch, (20 + (event_id * 17) % 80) / 100 AS confidence FROM segments)"


def _pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("rec_id", "speaker", (F.col("end") - F.col("start")).alias("dur"), F.expr("100 + (event_id * 31) % 140").alias("pitch"), F.expr("(20 + (event_id * 17) % 80) / 100").alias("confidence"))


@query(
    f"""WITH {_PITCH}, w AS (SELECT *, greatest(0.05, confidence) * greatest(0.1, dur) AS w FROM vp WHERE speaker IS NOT NULL),
    c AS (SELECT *, sum(w) OVER (PARTITION BY rec_id, speaker ORDER BY pitch) AS cum, sum(w) OVER (PARTITION BY rec_id, speaker) AS total FROM w),
    m AS (SELECT rec_id, speaker, min(pitch) FILTER (cum >= total / 2 - 1e-9) AS median, round(sum(w), 6) AS weight, count(*) AS samples FROM c GROUP BY 1, 2)
    SELECT rec_id, speaker, median AS pitch_hz, round(least(1, weight / 18), 3) AS pitch_confidence, CASE WHEN least(1, weight / 18) < 0.25 THEN 'unknown' WHEN median < 155 THEN 'low' WHEN median > 185 THEN 'high' ELSE 'mid' END AS voice_band, samples FROM m"""
)
def agg_voice_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vc.voice_profiles(_pitch(spark, sf_dir)).withColumn("pitch_hz", F.col("pitch_hz").cast("long"))


_MIX = f"""{_PITCH}, b AS (SELECT *, CASE WHEN pitch < 155 THEN 'low' WHEN pitch > 185 THEN 'high' END AS band, greatest(0.1, dur) AS d FROM vp WHERE speaker IS NOT NULL AND confidence >= 0.45),
    m AS (SELECT rec_id, speaker, round(coalesce(sum(d) FILTER (band = 'low'), 0), 6) AS low_s, round(coalesce(sum(d) FILTER (band = 'high'), 0), 6) AS high_s, count(*) FILTER (band = 'low') AS low_n, count(*) FILTER (band = 'high') AS high_n
      FROM b WHERE band IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, least(low_s, high_s) AS ms, CASE WHEN high_s >= low_s THEN low_n ELSE high_n END AS mn, least(low_s, high_s) / greatest(0.001, low_s + high_s) AS ratio FROM m),
    x AS (SELECT *, low_s + high_s >= 18 AND low_n + high_n >= 6 AND ms >= 6 AND mn >= 2 AND ratio >= 0.16 AS mixed FROM n), mix AS (SELECT *, mixed AND ms >= 10 AND ratio >= 0.22 AS severe FROM x)"""


@query(
    f"""WITH {_MIX} SELECT rec_id, speaker, CASE WHEN high_s >= low_s THEN 'high' ELSE 'low' END AS dominant_band, low_s, high_s, low_n, high_n, round(ratio, 6) AS minority_ratio, mixed, severe,
    round(CASE WHEN mixed THEN 4 + least(8, ms / 2) + least(4, ratio * 12) + CASE WHEN severe THEN 7 ELSE 0 END ELSE 0 END, 4) AS penalty FROM mix"""
)
def agg_voice_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vc.voice_mix(_pitch(spark, sf_dir))


@query(
    f"""WITH {_MIX} SELECT rec_id, count(*) FILTER (mixed) AS mixed_speakers, count(*) FILTER (severe) AS severe_speakers,
    round(sum(round(CASE WHEN mixed THEN 4 + least(8, ms / 2) + least(4, ratio * 12) + CASE WHEN severe THEN 7 ELSE 0 END ELSE 0 END, 4)), 3) AS penalty FROM mix GROUP BY 1"""
)
def agg_voice_mix_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = vc.voice_mix(_pitch(spark, sf_dir))
    return m.groupBy("rec_id").agg(F.count_if("mixed").alias("mixed_speakers"), F.count_if("severe").alias("severe_speakers"), F.round(F.sum("penalty"), 3).alias("penalty"))


@query("""SELECT event_id, CASE WHEN 20 + (event_id * 17) % 80 < 25 THEN 'unknown' WHEN 100 + (event_id * 31) % 140 < 155 THEN 'low' WHEN 100 + (event_id * 31) % 140 > 185 THEN 'high' ELSE 'mid' END AS band FROM events""", timeline=False)
def mt_voice_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", vc.voice_band(F.expr("100 + (event_id * 31) % 140"), F.expr("(20 + (event_id * 17) % 80) / 100")).alias("band"))
