"""Queries over further relations, aggregates and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.functions import udfs
from cadenza.operators import folds, select
from cadenza.operators import intervals as iv
from cadenza.operators import relate as rl
from cadenza.operators import review as rv
from cadenza.operators import runs as rn
from cadenza.operators.joins import in_ranges
from cadenza.plans.registry import query
from cadenza.plans.relations import _TURNS, _WIN, _turns, _windows
from cadenza.plans.scores import _GOLD, _gold
from cadenza.sources import readers, writers
from cadenza.sources.adapters import ranges, segments, table, turns


@query("SELECT rec_id, seg_idx, start, text, predicted AS speaker, round_even(value, 1) AS value FROM segments")
def proj_attach_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    labels = s.select("rec_id", "seg_idx", F.col("predicted").alias("speaker"), "value")
    return rl.attach(s.select("rec_id", "seg_idx", "start", "text", "speaker"), labels, {"speaker": None, "value": 1})


@query(
    f"""WITH {_TURNS}, c AS (SELECT s.rec_id, s.seg_idx, t.speaker, greatest(s.start, t.start) AS start, least(s."end", t."end") AS "end" FROM segments s JOIN tn t ON s.rec_id = t.rec_id AND t.start < s."end" AND t."end" > s.start),
    r AS (SELECT *, max("end") OVER (PARTITION BY rec_id, seg_idx, speaker ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
    g AS (SELECT *, sum(CASE WHEN start <= reach + 0.05 THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id, seg_idx, speaker ORDER BY start, "end") AS g FROM r)
    SELECT rec_id, seg_idx, speaker, min(start) AS start, max("end") AS "end" FROM g GROUP BY rec_id, seg_idx, speaker, g"""
)
def join_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.timelines(segments(spark, sf_dir), _turns(spark, sf_dir))


@query(
    f"""WITH {_TURNS}, c AS (SELECT s.rec_id, s.seg_idx, t.speaker, greatest(s.start, t.start) AS start, least(s."end", t."end") AS "end" FROM segments s JOIN tn t ON s.rec_id = t.rec_id AND t.start < s."end" AND t."end" > s.start),
    r AS (SELECT *, max("end") OVER (PARTITION BY rec_id, seg_idx, speaker ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c)
    SELECT rec_id, seg_idx, speaker, round(sum(greatest(0, "end" - greatest(start, coalesce(reach, start)))), 6) AS seconds FROM r GROUP BY 1, 2, 3"""
)
def arr_window_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.window_votes(segments(spark, sf_dir), _turns(spark, sf_dir))


@query(
    f"""WITH {_WIN}, p AS (SELECT w.rec_id, w.win, s.seg_idx, s.text, floor(round(greatest(0, w.start - s.start) / (s."end" - s.start) * length(s.text), 6)) AS a, ceil(round(least(1, (w."end" - s.start) / (s."end" - s.start)) * length(s.text), 6)) AS b
      FROM win w JOIN segments s ON s.rec_id = w.rec_id AND s.start < w."end" AND s."end" > w.start)
    SELECT rec_id, win, string_agg(substr(text, CAST(a AS INTEGER) + 1, CAST(b - a AS INTEGER)), '' ORDER BY seg_idx) AS text FROM p GROUP BY 1, 2"""
)
def join_overlap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.sliced_text(_windows(spark, sf_dir), segments(spark, sf_dir))


@query(
    """WITH c AS (SELECT rec_id, seg_idx, start - 0.03 AS a, least("end" + 0.18, coalesce(lead(start) OVER (PARTITION BY rec_id ORDER BY seg_idx), "end" + 0.18)) AS b, event_id % 6 <> 0 AS ok FROM segments), q AS (SELECT rec_id, CAST(seg_idx * 2.5 + 0.01 AS DOUBLE) AS t FROM segments)
    SELECT q.rec_id, q.t, min(c.seg_idx) AS cue_idx FROM q LEFT JOIN c ON c.rec_id = q.rec_id AND c.ok AND q.t >= c.a AND q.t <= c.b GROUP BY 1, 2"""
)
def join_asof_active_cue(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    cues = s.select("rec_id", F.col("seg_idx").alias("cue_idx"), "start", "end", F.expr("event_id % 6 <> 0").alias("reliable"))
    return rl.active_cue(s.select("rec_id", F.expr("CAST(seg_idx * 2.5BD + 0.01BD AS DOUBLE)").alias("t")), cues)


@query('SELECT DISTINCT s.rec_id, s.seg_idx FROM segments s JOIN ranges r ON r.rec_id = s.rec_id AND round((s.start + s."end") / 2, 6) BETWEEN r.start AND r."end"')
def join_in_any_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranges(spark, sf_dir)
    return in_ranges(segments(spark, sf_dir).join(r.select("rec_id").distinct(), "rec_id", "left_semi"), r).select("rec_id", "seg_idx")


@query("WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id, lang FROM documents), c AS (SELECT doc_id, source FROM documents WHERE length(text) > 500) SELECT a.doc_id, lang, source FROM a JOIN b ON a.doc_id = b.doc_id JOIN c ON a.doc_id = c.doc_id", timeline=False)
def join_prefetch_model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    a = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return a.join(d.select("doc_id", "lang"), "doc_id").join(d.where("length(text) > 500").select("doc_id", "source"), "doc_id")


@query(
    """WITH i AS (SELECT doc_id, md5(text) AS h FROM documents), n AS (SELECT h, max(doc_id) AS doc_id FROM i GROUP BY 1), o AS (SELECT * FROM i WHERE doc_id % 4 = 0)
    SELECT doc_id, h, sha256('s:' || h) AS selection FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o) AND h NOT IN (SELECT h FROM o) ORDER BY selection LIMIT 50""",
    timeline=False,
)
def join_anti_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return rl.without_history(i, i.where("doc_id % 4 = 0"), "doc_id", "h", "s", 50)


@query(f"WITH {_GOLD} SELECT a.id, b.id AS other, round(levenshtein(a.h, b.h) / greatest(length(a.h), 1), 6) AS cer FROM n a JOIN n b ON a.backend = b.backend AND a.id // 50 = b.id // 50 AND a.id < b.id", timeline=False)
def join_self_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gold(spark, sf_dir).select("id", "h", "backend", F.expr("id div 50").alias("block"))
    o = g.select(F.col("id").alias("other"), F.col("h").alias("k"), "backend", "block")
    return g.join(o, ["backend", "block"]).where("id < other").select("id", "other", F.round(F.levenshtein("h", "k") / F.greatest(F.length("h"), F.lit(1)), 6).alias("cer"))


@query('SELECT rec_id, speaker, count(*) AS segments, round(sum("end" - start), 6) AS seconds, CAST(sum(length(text)) AS BIGINT) AS chars FROM segments WHERE speaker IS NOT NULL GROUP BY 1, 2')
def agg_speaker_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = rn.labelled(segments(spark, sf_dir)).groupBy("rec_id", "speaker")
    return g.agg(F.count("*").alias("segments"), F.round(F.sum(F.col("end") - F.col("start")), 6).alias("seconds"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {_GOLD} SELECT round(sum(levenshtein(r, h)) / sum(length(r)), 6) AS cer FROM n WHERE length(r) > 0", timeline=False)
def agg_micro_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir).where("length(r) > 0").agg(F.round(F.sum(F.levenshtein("r", "h")) / F.sum(F.length("r")), 6).alias("cer"))


@query(f"WITH {_GOLD}, s AS (SELECT backend, round(sum(levenshtein(r, h)) / sum(length(r)), 6) AS cer FROM n GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY cer, backend) AS INTEGER) AS rank FROM s", timeline=False)
def agg_backend_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _gold(spark, sf_dir).groupBy("backend").agg(F.round(F.sum(F.levenshtein("r", "h")) / F.sum(F.length("r")), 6).alias("cer"))
    return select.ranked(s, [F.lit(1)], ["cer", "backend"])  # one row per backend


@query("SELECT event_type, count(*) AS items, count(*) FILTER (event_id % 2 = 0) AS baseline, count(*) FILTER (event_id % 3 = 0) AS current, count(*) FILTER (event_id % 2 <> 0 AND event_id % 3 = 0) AS repaired, count(*) FILTER (event_id % 2 = 0 AND event_id % 3 <> 0) AS regressions FROM events GROUP BY 1", timeline=False)
def agg_turn_metrics_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = F.expr("event_id % 2 = 0"), F.expr("event_id % 3 = 0")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("items"), F.count_if(b).alias("baseline"), F.count_if(c).alias("current"), F.count_if(~b & c).alias("repaired"), F.count_if(b & ~c).alias("regressions"))


@query(
    """WITH r AS (SELECT rec_id, seg_idx // 4 AS item, seg_idx, speaker AS g, CASE WHEN seg_idx // 4 % 3 = 0 THEN coalesce(speaker, '') ELSE predicted END AS c FROM segments),
    n AS (SELECT rec_id, item, list(coalesce(g, '') ORDER BY seg_idx) AS g, list(c ORDER BY seg_idx) AS c FROM r GROUP BY 1, 2),
    k AS (SELECT rec_id, item, [g[i] FOR i IN range(1, len(g) + 1) IF i = 1 OR g[i] <> g[i - 1]] AS g, [c[i] FOR i IN range(1, len(c) + 1) IF i = 1 OR c[i] <> c[i - 1]] AS c FROM n)
    SELECT rec_id, item, CASE WHEN c = g THEN '' WHEN len(c) < len(g) THEN '漏掉换人' WHEN len(c) > len(g) THEN '额外误切' ELSE '人员或顺序错误' END AS error_type FROM k"""
)
def agg_error_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every four rows are an item, whose predicted labels are right in one item of three."""
    s = segments(spark, sf_dir).withColumn("item", F.expr("seg_idx div 4"))
    said = F.expr("CASE WHEN item % 3 = 0 THEN coalesce(speaker, '') ELSE predicted END")
    rows = s.groupBy("rec_id", "item").agg(F.array_sort(F.collect_list(F.struct("seg_idx", F.coalesce("speaker", F.lit("")).alias("g"), said.alias("c")))).alias("x"))
    return rows.select("rec_id", "item", rv.error_type(F.col("x.c"), F.col("x.g")).alias("error_type"))


@query(
    """WITH f AS (SELECT user_id AS rec_id, value / 100 AS rms FROM events), p AS (SELECT rec_id, quantile_cont(rms, 0.15) AS noise, quantile_cont(rms, 0.85) AS level FROM f GROUP BY 1)
    SELECT p.rec_id, round(noise, 6) AS noise, round(level, 6) AS level, round(20 * log10(greatest(level, 1e-9) / greatest(noise, 1e-9)), 6) AS snr, round(avg(CASE WHEN rms <= noise * 1.2 THEN 1.0 ELSE 0.0 END), 6) AS silence FROM f JOIN p ON f.rec_id = p.rec_id GROUP BY 1, noise, level""",
    timeline=False,
)
def agg_audio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.signal_quality(table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), (F.col("value") / 100).alias("rms")))


@query("SELECT user_id AS rec_id, round(corr(value, event_id % 10), 6) AS correlation, round(sqrt(avg(value * value)), 6) AS x_rms, round(sqrt(avg((event_id % 10) * (event_id % 10))), 6) AS y_rms FROM events GROUP BY 1", timeline=False)
def agg_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.audio_channels(table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), F.col("value").alias("x"), F.expr("CAST(event_id % 10 AS DOUBLE)").alias("y")))


@query("SELECT rec_id, min(start) AS first, max(\"end\") AS last, greatest(0, min(start) - 0.5) AS omitted FROM segments GROUP BY 1")
def agg_annotation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).groupBy("rec_id").agg(F.min("start").alias("first"), F.max("end").alias("last"), F.greatest(F.lit(0.0), F.min("start") - 0.5).alias("omitted"))


@query("SELECT doc_id % 20 AS rec_id, count(*) FILTER (trim(text, ' ') <> text) AS changed, count(*) AS rows FROM documents GROUP BY 1", timeline=False)
def agg_normalize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.expr("doc_id % 20").alias("rec_id")).agg(F.count_if(F.trim("text") != F.col("text")).alias("changed"), F.count("*").alias("rows"))


@query('SELECT rec_id, seg_idx, round(greatest(0, lead(start) OVER (PARTITION BY rec_id ORDER BY seg_idx) - "end"), 6) AS gap FROM segments QUALIFY lead(start) OVER (PARTITION BY rec_id ORDER BY seg_idx) IS NOT NULL')
def win_segment_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = segments(spark, sf_dir).withColumn("next", F.lead("start").over(rn.order())).where("next IS NOT NULL")
    return g.select("rec_id", "seg_idx", F.round(F.greatest(F.lit(0.0), F.col("next") - F.col("end")), 6).alias("gap"))


@query(
    """WITH sp AS (SELECT rec_id, min(start) AS a, max("end") AS b FROM segments GROUP BY 1), w AS (SELECT rec_id, unnest(range(0, CAST(greatest(0, floor((b - a - 20) / 5)) AS BIGINT) + 1)) AS win, a FROM sp),
    x AS (SELECT rec_id, win, round(a + win * 5, 6) AS start, round(a + win * 5, 6) + 20 AS "end" FROM w),
    p AS (SELECT x.rec_id, win, s.speaker, round(sum(least(x."end", s."end") - greatest(x.start, s.start)), 6) AS s FROM x JOIN segments s ON s.rec_id = x.rec_id AND s.speaker IS NOT NULL AND s.start < x."end" AND s."end" > x.start GROUP BY 1, 2, 3),
    c AS (SELECT rec_id, win, count(*) FILTER (s >= 2) AS voices, min(s) AS least, round(sum(s), 6) AS speech FROM p GROUP BY 1, 2)
    SELECT rec_id, win, voices, least, speech FROM c QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY voices DESC, least DESC, speech DESC, win) = 1"""
)
def win_sliding_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.sliding_best(segments(spark, sf_dir), 20.0, 5.0, 2.0).withColumn("win", F.col("win").cast("long"))


@query(
    """WITH c AS (SELECT user_id AS rec_id, event_id % 5 * 4 AS first, event_id % 8 AS i, 8 AS size, value AS score FROM events), w AS (SELECT *, 0.54 - 0.46 * cos(2 * pi() * i / 7) AS w FROM c)
    SELECT rec_id, first + i AS frame, round(sum(w * score) / sum(w), 6) AS score FROM w GROUP BY 1, 2""",
    timeline=False,
)
def win_overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").selectExpr("user_id AS rec_id", "event_id % 5 * 4 AS first", "event_id % 8 AS i", "8 AS size", "value AS score")
    return rl.weighted_average(c)


@query("SELECT rec_id, unnest(list_distinct(list_append(range(0, CAST(floor(greatest(0, m - 10)) AS BIGINT) + 1, 5), CAST(floor(greatest(0, m - 10)) AS BIGINT)))) AS start FROM (SELECT rec_id, max(\"end\") AS m FROM segments GROUP BY 1)")
def win_chunk_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = segments(spark, sf_dir).groupBy("rec_id").agg(F.floor(F.greatest(F.lit(0.0), F.max("end") - 10)).alias("m"))
    return m.select("rec_id", F.explode(F.array_union(F.sequence(F.lit(0).cast("long"), F.col("m"), F.lit(5).cast("long")), F.array("m"))).alias("start"))


@query("SELECT rec_id, start, \"end\", speaker, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY start, \"end\", speaker) AS INTEGER) AS place FROM segments WHERE speaker IS NOT NULL")
def sort_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.ranked(rn.labelled(segments(spark, sf_dir)).select("rec_id", "start", "end", "speaker"), ["rec_id"], ["start", "end", "speaker"], "place")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(trim(text, ' '), '\\s+', ' ', 'g'), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 80", timeline=False)
def topk_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \t\n\r\f]+")).alias("word")).where("word <> ''")
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(80)


@query('SELECT rec_id, seg_idx, greatest(start, 5) AS start, least("end", 60) AS "end" FROM segments WHERE "end" > 5 AND start < 60')
def iv_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = segments(spark, sf_dir).select("rec_id", F.lit(5.0).alias("start"), F.lit(60.0).alias("end")).distinct()
    p = iv.overlap_join(segments(spark, sf_dir).select("rec_id", "seg_idx", "start", "end"), cover)
    return p.select("rec_id", "seg_idx", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))


@query('SELECT rec_id, seg_idx, round(CASE WHEN 30 < start THEN start - 30 WHEN 30 > "end" THEN 30 - "end" ELSE 0 END, 6) AS distance FROM segments')
def iv_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.greatest(F.lit(0.0), F.col("start") - 30, 30 - F.col("end"))
    return segments(spark, sf_dir).select("rec_id", "seg_idx", F.round(d, 6).alias("distance"))


@query("WITH l AS (SELECT event_id, [event_id % 3, event_id % 5, event_id % 7, event_id % 2] AS l FROM events) SELECT event_id, round((exp(l[3]) + exp(l[4])) / (exp(l[1]) + exp(l[2]) + exp(l[3]) + exp(l[4])), 6) AS p FROM l", timeline=False)
def iv_powerset_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.array(*(F.expr(f"CAST(event_id % {k} AS DOUBLE)") for k in (3, 5, 7, 2)))
    return table(spark, sf_dir, "events").select("event_id", F.round(rl.powerset_overlap(logits, [2, 3]), 6).alias("p"))


@query("SELECT 'a' AS source, rec_id, seg_idx FROM segments WHERE speaker IS NULL UNION ALL SELECT 'b', rec_id, seg_idx FROM segments WHERE length(text) < 4")
def set_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("rec_id", "seg_idx", "speaker", "text")
    a, b = s.where("speaker IS NULL").withColumn("source", F.lit("a")), s.where("length(text) < 4").withColumn("source", F.lit("b"))
    return a.unionByName(b).select("source", "rec_id", "seg_idx")


@query("SELECT rec_id, seg_idx, CASE WHEN speaker IS NULL THEN 'strong' WHEN length(text) < 4 THEN 'weak' ELSE 'normal' END AS pool FROM segments WHERE trim(text) <> ''")
def set_flag_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).where("trim(text) <> ''").select("rec_id", "seg_idx", "speaker", "text")
    key = ["rec_id", "seg_idx"]
    strong = s.where("speaker IS NULL")
    weak = s.where("length(text) < 4").join(strong.select(*key), key, "left_anti")
    rest = s.join(strong.unionByName(weak).select(*key), key, "left_anti")
    pool = lambda d, n: d.select(*key, F.lit(n).alias("pool"))
    return pool(strong, "strong").unionByName(pool(weak, "weak")).unionByName(pool(rest, "normal"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(b.v, a.v) AS v FROM (SELECT doc_id, quality AS v FROM labels WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id, toxic AS v FROM labels WHERE doc_id % 2 = 0) b ON a.doc_id = b.doc_id", timeline=False)
def set_merge_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    a, b = lb.where("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("old")), lb.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("new"))
    return a.join(b, "doc_id", "full").select("doc_id", F.coalesce("new", "old").alias("v"))


@query(f"WITH {_GOLD} SELECT id, round(levenshtein(h, r) / greatest(length(h), 1), 6) AS cer FROM n", timeline=False)
def al_self_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir).select("id", F.round(F.levenshtein("h", "r") / F.greatest(F.length("h"), F.lit(1)), 6).alias("cer"))


@query("SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 0 ELSE value END AS value, round(CASE WHEN event_id % 10 > 0 THEN value / (event_id % 10) END, 6) AS rtf FROM events", timeline=False)
def mt_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return table(spark, sf_dir, "events").select("event_id", F.when(ok, v).otherwise(0.0).alias("value"), F.round(F.try_divide(v, F.expr("event_id % 10")), 6).alias("rtf"))


@query("SELECT event_id, (event_id // 60) || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS text FROM events", timeline=False)
def tm_duration_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.format_string("%d:%02d", F.expr("event_id div 60"), F.expr("event_id % 60")).alias("text"))


@query("SELECT rec_id, speaker, predicted, count(*) AS n FROM segments WHERE speaker <> predicted GROUP BY 1, 2, 3")
def map_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = segments(spark, sf_dir).where("speaker <> predicted").groupBy("rec_id", "speaker", "predicted").agg(F.count("*").alias("n"))
    nested = per.groupBy("rec_id", "speaker").agg(F.map_from_entries(F.collect_list(F.struct("predicted", "n"))).alias("to"))
    return nested.select("rec_id", "speaker", F.explode("to").alias("predicted", "n"))


@query("SELECT rec_id, seg_idx, round(start + 12.5, 6) AS start, round(\"end\" + 12.5, 6) AS \"end\" FROM segments")
def arr_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = segments(spark, sf_dir).groupBy("rec_id").agg(F.collect_list(F.struct("seg_idx", "start", "end")).alias("a"))
    moved = F.transform("a", lambda x: F.struct(x["seg_idx"].alias("seg_idx"), F.round(x["start"] + 12.5, 6).alias("start"), F.round(x["end"] + 12.5, 6).alias("end")))
    return whole.select("rec_id", F.inline(moved))


@query("WITH d AS (SELECT doc_id, md5(text) AS h FROM documents) SELECT doc_id, length(h) = 32 AS ok FROM d", timeline=False)
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.to_json(F.struct("doc_id", "lang", "text")), 256).alias("h"))
    return d.select("doc_id", (F.length("h") == 64).alias("ok"))


@query(f"""SELECT rec_id, count(*) AS cues, round(min(start), 3) AS first FROM segments WHERE trim(text) <> '' GROUP BY 1""")
def ig_export_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rl.parsed_srt(writers.srt(segments(spark, sf_dir)))
    ok = p.where("number >= 1 AND end > start AND text <> ''")
    return ok.groupBy("rec_id").agg(F.max("number").cast("long").alias("cues"), F.round(F.min("start"), 3).alias("first"))


@query(
    """WITH i AS (SELECT user_id AS rec_id, event_id % 50 AS id, value AS start, CASE WHEN event_id % 8 = 0 THEN value - 1 ELSE value + 1 END AS "end", event_type AS status FROM events), n AS (SELECT *, count(*) OVER (PARTITION BY rec_id, id) AS n FROM i)
    SELECT rec_id, id, unnest(list_filter([CASE WHEN n > 1 THEN 'duplicate_id' END, CASE WHEN NOT (start >= 0 AND "end" > start) THEN 'bad_time' END, CASE WHEN status NOT IN ('view', 'click') THEN 'bad_status' END], lambda x: x IS NOT NULL)) AS code FROM n""",
    timeline=False,
)
def ig_review_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "events").selectExpr("user_id AS rec_id", "event_id % 50 AS id", "value AS start", "CASE WHEN event_id % 8 = 0 THEN value - 1 ELSE value + 1 END AS end", "event_type AS status")
    return rl.review_schema(i, ["view", "click"])


@query("SELECT user_id AS rec_id, event_id, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS label FROM events", timeline=False)
def scan_human_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("label", F.expr("CASE WHEN event_id % 4 = 0 THEN event_type END"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return e.select(F.col("user_id").alias("rec_id"), "event_id", F.last("label", ignorenulls=True).over(w).alias("label"))


@query("SELECT event_id, event_type AS kind, CAST(value AS VARCHAR) AS amount FROM events", timeline=False)
def scan_markdown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("| "), F.col("event_id"), F.lit(" | "), F.col("event_type"), F.lit(" | "), F.col("value").cast("string"), F.lit(" |"))
    lines = table(spark, sf_dir, "events").select(line.alias("value")).unionByName(spark.createDataFrame([("|---|:-:|---|",), ("text",)], "value string"))
    c = F.col("cells")
    return readers.markdown_table(lines).select(c[0].cast("long").alias("event_id"), c[1].alias("kind"), c[2].alias("amount"))


@query()
def rv_rapid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rn.rapid_alternation(segments(spark, sf_dir), 8.0, 4, 2).join(segments(spark, sf_dir).select("rec_id", "seg_idx", "start"), ["rec_id", "seg_idx"])
    return folds.grouped(found, lambda rows: folds.skip_ahead(rows, 8.0), "rec_id long, seg_idx int")


@query()
def vec_permutation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).where("speaker IS NOT NULL").select("rec_id", "seg_idx", "speaker", "predicted")
    best = lambda rows: [{"have": a, "want": b} for a, b in folds.best_permutation([(r["predicted"], r["speaker"]) for r in rows]).items()]
    return folds.grouped(s, best, "rec_id long, have string, want string")


@query()
def str_recovery_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace(F.lower(udfs.nfkc("text")), rf"[^{tx.CJK[1:-1]}a-z0-9]", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("form"))
