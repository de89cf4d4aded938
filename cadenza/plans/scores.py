"""Queries that score, rank, select, sample, check and read; folds and assignments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.functions import udfs
from cadenza.functions.numbers import scaled_round
from cadenza.operators import folds, integrity, layers, select
from cadenza.operators import intervals as iv
from cadenza.plans.registry import query
from cadenza.plans.timeline import _OWN, _sides
from cadenza.sources import readers
from cadenza.sources.adapters import segments, table, turns

_RUNS = """b AS (SELECT l_orderkey % 40 AS audio, l_linenumber AS backend, CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS risk, CAST(l_quantity AS BIGINT) AS strong,
    l_suppkey AS review, l_discount AS rtf, l_partkey AS part, l_orderkey AS id FROM lineitem)"""


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.expr("l_orderkey % 40").alias("audio"), F.col("l_linenumber").alias("backend"), F.expr("CASE WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'A' THEN 1 ELSE 0 END").alias("risk"), F.col("l_quantity").cast("long").alias("strong"), F.col("l_suppkey").alias("review"), F.col("l_discount").alias("rtf"), F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("id"))


@query(f"WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY audio ORDER BY risk, strong, review, rtf, id, backend, part) AS rank FROM b) SELECT audio, id, backend, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5", timeline=False)
def sort_rank_backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = select.top_per(_bench(spark, sf_dir), ["audio"], ["risk", "strong", "review", "rtf", "id", "backend", "part"], 5)
    return select.ranked(top, ["audio"], ["risk", "strong", "review", "rtf", "id", "backend", "part"]).select("audio", "id", "backend", "rank")


@query(f"WITH {_RUNS} SELECT audio, max(risk) AS risk, CAST(sum(strong) AS BIGINT) AS strong, CAST(sum(review) AS BIGINT) AS review, round(avg(rtf), 6) AS rtf, array_to_string(list_sort(list(DISTINCT backend)), ',') AS filters, count(*) AS ok_count FROM b GROUP BY 1", timeline=False)
def agg_preflight_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _bench(spark, sf_dir).groupBy("audio")
    return g.agg(F.max("risk").alias("risk"), F.sum("strong").alias("strong"), F.sum("review").alias("review"), F.round(F.avg("rtf"), 6).alias("rtf"), F.array_join(F.array_sort(F.collect_set("backend")), ",").alias("filters"), F.count("*").alias("ok_count"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3", timeline=False)
def topk_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.top_per(table(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), "event_id"], 3).select("user_id", "event_id", "value")


@query(
    """WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events)
    SELECT user_id, event_id, value FROM r ORDER BY CASE WHEN r > 1 THEN 1 ELSE 0 END, value DESC, event_id LIMIT 200""",
    timeline=False,
)
def topk_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return select.quota_then_fill(e, "user_id", [F.desc("value"), "event_id"], 1, 200)


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50", timeline=False)
def topk_worst_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(50)


@query("SELECT doc_id, quality, toxic FROM (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5('s:' || doc_id), doc_id) AS r FROM labels) WHERE r <= 10", timeline=False)
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.sample_stratified(table(spark, sf_dir, "labels"), ["quality", "toxic"], "doc_id", 10, "s").select("doc_id", "quality", "toxic")


@query("SELECT doc_id, sha256('s:' || doc_id) AS selection FROM labels ORDER BY 2 LIMIT 60", timeline=False)
def sample_hash_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.hash_order(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "s", 60)


@query(
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, event_id FROM r WHERE i % greatest(1, n // 8) = 0""",
    timeline=False,
)
def sample_linspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    r = e.withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).withColumn("n", F.count("*").over(W.partitionBy("user_id")))
    return r.where("i % greatest(1, n div 8) = 0").select("user_id", "event_id")


@query("SELECT user_id, event_type, event_id, copies FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS copies FROM events) WHERE r = 1", timeline=False)
def set_dedupe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.keep_best(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("value"), "event_id"]).select("user_id", "event_type", "event_id", "copies")


@query("SELECT event_type, min(event_id) AS first FROM events GROUP BY 1", timeline=False)
def set_dedupe_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first"))


@query(
    """WITH a AS (SELECT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id, event_type FROM events WHERE event_id % 2 = 1)
    SELECT 'inherited' AS side, * FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) UNION ALL SELECT 'new', * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""",
    timeline=False,
)
def set_diff_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a, b = (e.where(f"event_id % 2 = {i}").select("user_id", "event_type") for i in (0, 1))
    same, new = select.multiset_difference(a, b)
    return same.withColumn("side", F.lit("inherited")).unionByName(new.withColumn("side", F.lit("new")))


@query(
    """WITH i AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS t, [event_type, 'x' || event_id % 2] AS reasons FROM events),
    r AS (SELECT user_id, event_id, unnest(reasons) AS reason, unnest([1, 2]) AS j FROM i), f AS (SELECT user_id, reason, min((event_id, j)) AS pl FROM r GROUP BY 1, 2), u AS (SELECT user_id, string_agg(reason, '+' ORDER BY pl) AS reasons FROM f GROUP BY 1)
    SELECT u.user_id, t.t, u.reasons FROM u JOIN (SELECT user_id, arg_min(t, event_id) FILTER (t IS NOT NULL) AS t FROM i GROUP BY 1) t ON u.user_id = t.user_id""",
    timeline=False,
)
def set_merge_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("CASE WHEN event_id % 3 <> 0 THEN event_type END").alias("t"), F.expr("array(event_type, concat('x', event_id % 2))").alias("reasons"))
    return select.merge_items(e, ["user_id"], "event_id", ["t"], "reasons").select("user_id", "t", F.array_join("reasons", "+").alias("reasons"))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.quality, b.toxic FROM (SELECT * FROM labels WHERE quality = 0) a FULL JOIN (SELECT * FROM labels WHERE toxic = 1) b ON a.doc_id = b.doc_id", timeline=False)
def set_full_outer_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    a, b = lb.where("quality = 0").select("doc_id", "quality"), lb.where("toxic = 1").select("doc_id", "toxic")
    return a.join(b, "doc_id", "full")


@query(
    """SELECT CASE WHEN grouping(quality) = 0 THEN 'quality' WHEN grouping(toxic) = 0 THEN 'toxic' ELSE 'all' END AS key, quality, toxic, count(*) AS items, count(*) FILTER (doc_id % 2 = quality) AS correct, round(count(*) FILTER (doc_id % 2 = quality) / count(*), 6) AS accuracy
    FROM labels GROUP BY GROUPING SETS ((quality), (toxic), ())""",
    timeline=False,
)
def agg_group_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    g = lb.groupingSets([[F.col("quality")], [F.col("toxic")], []], "quality", "toxic")
    hit = F.count_if(F.expr("doc_id % 2 = quality"))
    key = F.when(F.grouping("quality") == 0, "quality").when(F.grouping("toxic") == 0, "toxic").otherwise("all")
    out = g.agg(key.alias("key"), F.count("*").alias("items"), hit.alias("correct"), F.round(hit / F.count("*"), 6).alias("accuracy"))
    return out.select("key", "quality", "toxic", "items", "correct", "accuracy")


_GOLD = "g AS (SELECT event_id AS id, event_type || ' ' || event_id % 100 AS ref, CASE WHEN event_id % 4 = 0 THEN event_type || event_id % 90 ELSE event_type || ', ' || event_id % 100 END AS hyp, event_type AS backend FROM events), n AS (SELECT *, regexp_replace(ref, '[\\p{P}\\p{Z}\\s]', '', 'g') AS r, regexp_replace(hyp, '[\\p{P}\\p{Z}\\s]', '', 'g') AS h FROM g)"


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr("concat(event_type, ' ', event_id % 100)").alias("ref"), F.expr("CASE WHEN event_id % 4 = 0 THEN concat(event_type, event_id % 90) ELSE concat(event_type, ', ', event_id % 100) END").alias("hyp"), F.col("event_type").alias("backend"))
    return g.withColumn("r", tx.scoring_form("ref")).withColumn("h", tx.scoring_form("hyp"))


@query(f"WITH {_GOLD} SELECT id, levenshtein(r, h) AS edits, length(r) AS ref_chars, round(levenshtein(r, h) / length(r), 6) AS cer FROM n", timeline=False)
def al_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.levenshtein("r", "h").cast("long")
    return _gold(spark, sf_dir).select("id", e.alias("edits"), F.length("r").cast("long").alias("ref_chars"), F.round(e / F.length("r"), 6).alias("cer"))


@query(f"WITH {_GOLD} SELECT count(*) AS rows, CAST(sum(levenshtein(r, h)) AS BIGINT) AS edits, CAST(sum(length(r)) AS BIGINT) AS ref_chars, round(sum(levenshtein(r, h)) / sum(length(r)), 6) AS cer FROM n", timeline=False)
def agg_cer_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.sum(F.levenshtein("r", "h"))
    return _gold(spark, sf_dir).agg(F.count("*").alias("rows"), e.alias("edits"), F.sum(F.length("r")).alias("ref_chars"), F.round(e / F.sum(F.length("r")), 6).alias("cer"))


@query(f"WITH {_GOLD} SELECT backend, CAST(sum(levenshtein(r, h)) AS BIGINT) AS edits, round(sum(levenshtein(r, h)) / sum(length(r)), 6) AS cer, count(*) FILTER (levenshtein(r, h) = 0) AS perfect FROM n GROUP BY 1", timeline=False)
def agg_benchmark_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.levenshtein("r", "h")
    return _gold(spark, sf_dir).groupBy("backend").agg(F.sum(e).alias("edits"), F.round(F.sum(e) / F.sum(F.length("r")), 6).alias("cer"), F.count_if(e == 0).alias("perfect"))


@query(f"WITH {_GOLD} SELECT backend, count(DISTINCT md5(hyp)) AS outputs, count(DISTINCT id % 10) AS cases, max(length(hyp)) AS longest FROM g GROUP BY 1", timeline=False)
def agg_variant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir).groupBy("backend").agg(F.count_distinct(F.md5("hyp")).alias("outputs"), F.count_distinct(F.expr("id % 10")).alias("cases"), F.max(F.length("hyp")).cast("long").alias("longest"))


@query()
def al_levenshtein_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir).select("id", udfs.levenshtein_ops("r", "h").alias("o")).select("id", "o.*")


@query()
def al_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir).select("id", F.round(udfs.similarity(udfs.nfkc("r"), udfs.nfkc("h")), 6).alias("similarity"))


@query()
def al_local_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark")
    b = t.select("item_id", F.col("text").alias("ref")).join(t.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hyp")), "item_id")
    return b.select("item_id", udfs.best_local_alignment("ref", "hyp").alias("o")).select("item_id", "o.*")


@query()
def agg_gold_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gold(spark, sf_dir).select("id", tx.word_tokens("ref").alias("a"), tx.word_tokens("hyp").alias("b"))
    return g.agg(F.sum(udfs.token_distance("a", "b")).alias("edits"), F.sum(F.size("a")).alias("tokens"))


_ASSIGN = f"""{_OWN}, ps AS MATERIALIZED (SELECT rec_id, p AS pred, r AS ref, round(sum("end" - start), 6) AS sec FROM (SELECT rec_id, start, "end", ref, unnest(pred) AS p FROM act) x, unnest(ref) t(r) GROUP BY 1, 2, 3),
    pn AS MATERIALIZED (SELECT rec_id, pred, row_number() OVER (PARTITION BY rec_id ORDER BY pred) AS i FROM (SELECT DISTINCT rec_id, pred FROM ps)),
    op AS MATERIALIZED (SELECT pn.rec_id, pn.i, pn.pred, ps.ref, ps.sec FROM pn JOIN ps ON pn.rec_id = ps.rec_id AND pn.pred = ps.pred WHERE sec > 1e-9 UNION ALL SELECT rec_id, i, pred, NULL, 0 FROM pn),
    tree AS (SELECT rec_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST([] AS VARCHAR[]) AS who, CAST(0 AS DOUBLE) AS total FROM pn WHERE i = 1 UNION ALL
      SELECT t.rec_id, o.i, CASE WHEN o.ref IS NULL THEN used ELSE list_append(used, o.ref) END, CASE WHEN o.ref IS NULL THEN who ELSE list_append(who, o.pred) END, total + o.sec FROM tree t JOIN op o ON o.rec_id = t.rec_id AND o.i = t.i + 1 AND (o.ref IS NULL OR NOT list_contains(used, o.ref))),
    best AS MATERIALIZED (SELECT rec_id, used, who FROM tree WHERE len(used) > 0 QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY round(total, 6) DESC, len(used) DESC) = 1),
    mapped AS (SELECT rec_id, unnest(who) AS pred, unnest(used) AS ref FROM best)"""


_DER = f"""{_ASSIGN}, d AS (SELECT rec_id, "end" - start AS d, ref, pred, len(ref) AS r, len(pred) AS p FROM act),
    pt AS (SELECT rec_id, round(sum(r * d), 6) AS reference_s, round(sum(greatest(0, r - p) * d), 6) AS miss_s, round(sum(greatest(0, p - r) * d), 6) AS false_alarm_s, round(sum(least(r, p) * d), 6) AS matchable_s FROM d GROUP BY 1),
    rs AS (SELECT rec_id, x AS ref, sum(d) AS ref_s FROM (SELECT rec_id, d, unnest(ref) AS x FROM d) GROUP BY 1, 2), pr AS (SELECT rec_id, x AS pred, sum(d) AS pred_s FROM (SELECT rec_id, d, unnest(pred) AS x FROM d) GROUP BY 1, 2),
    jr AS (SELECT rs.rec_id, rs.ref, coalesce(ps.sec, 0) AS both_s, coalesce(1 - ps.sec / (ref_s + pred_s - ps.sec), 1.0) AS jer FROM rs LEFT JOIN mapped m ON rs.rec_id = m.rec_id AND rs.ref = m.ref
      LEFT JOIN ps ON ps.rec_id = m.rec_id AND ps.pred = m.pred AND ps.ref = m.ref LEFT JOIN pr ON pr.rec_id = m.rec_id AND pr.pred = m.pred)"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.diarization_errors(iv.active_sets(*_sides(spark, sf_dir)))


@query(
    f"""WITH RECURSIVE {_DER}, j AS (SELECT rec_id, avg(jer) AS jer, sum(both_s) AS correct FROM jr GROUP BY 1)
    SELECT pt.rec_id, reference_s, miss_s, false_alarm_s, round(matchable_s - correct, 6) AS confusion_s, round((miss_s + false_alarm_s + matchable_s - correct) / reference_s, 6) AS der, round(jer, 6) AS jer FROM pt JOIN j ON pt.rec_id = j.rec_id"""
)
def agg_der_jer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diarization and Jaccard error with the best mapping of predicted to reference speakers."""
    parts = ("reference_s", "miss_s", "false_alarm_s", "matchable_s")
    rows = _errors(spark, sf_dir).groupBy("rec_id").agg(*(F.first(c).alias(c) for c in parts), F.avg("jer").alias("jer"), F.sum("correct").alias("correct")).where("jer IS NOT NULL")
    confusion = F.col("matchable_s") - F.col("correct")
    der = (F.col("miss_s") + F.col("false_alarm_s") + F.col("matchable_s") - F.col("correct")) / F.col("reference_s")
    return rows.select("rec_id", "reference_s", "miss_s", "false_alarm_s", scaled_round(confusion, 6).alias("confusion_s"), scaled_round(der, 6).alias("der"), scaled_round("jer", 6).alias("jer"))


@query(
    f"""WITH RECURSIVE {_DER}, n AS (SELECT rec_id, count(DISTINCT ref) AS r FROM rs GROUP BY 1), m AS (SELECT rec_id, count(DISTINCT pred) AS p FROM pr GROUP BY 1),
    o AS (SELECT coalesce(p, 0) - coalesce(r, 0) AS off FROM n FULL JOIN m ON n.rec_id = m.rec_id),
    t AS (SELECT sum(reference_s) AS reference_s, sum(miss_s) + sum(false_alarm_s) + sum(matchable_s) AS lost, count(*) AS recordings FROM pt)
    SELECT round((lost - (SELECT sum(both_s) FROM jr)) / reference_s, 6) AS der, round((SELECT avg(jer) FROM jr), 6) AS jer, round((SELECT avg(abs(off)) FROM o), 6) AS speaker_count_error,
      round((SELECT avg(CASE WHEN off = 0 THEN 1.0 ELSE 0.0 END) FROM o), 6) AS speaker_count_right, recordings FROM t"""
)
def agg_der_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of all recordings: seconds are summed, Jaccard errors averaged over all speakers, differences in numbers of speakers averaged."""
    each = _errors(spark, sf_dir)
    parts = ("reference_s", "miss_s", "false_alarm_s", "matchable_s", "refs", "preds")
    rows = each.groupBy("rec_id").agg(*(F.first(c).alias(c) for c in parts), F.sum("jer").alias("jer"), F.count("jer").alias("n"), F.sum("correct").alias("correct"))
    off, total = F.col("preds") - F.col("refs"), F.sum
    lost = total("miss_s") + total("false_alarm_s") + total("matchable_s") - total("correct")
    return rows.agg(
        F.round(lost / total("reference_s"), 6).alias("der"),
        F.round(total("jer") / total("n"), 6).alias("jer"),
        F.round(F.avg(F.abs(off)), 6).alias("speaker_count_error"),
        F.round(F.avg((off == 0).cast("int")), 6).alias("speaker_count_right"),
        F.count("*").alias("recordings"),
    )


def _fold(spark: SparkSession, sf_dir: str, f, schema: str) -> DataFrame:
    return folds.grouped(segments(spark, sf_dir).select("rec_id", "seg_idx", "start", "end", "text", "speaker", "value"), f, schema)


def _span_sql(span: float, gap: float | None) -> str:
    near = "" if gap is None else f" AND s.start - w.we <= {gap} + 1e-9"
    return f"""WITH RECURSIVE g AS MATERIALIZED (SELECT * FROM segments), w AS (SELECT rec_id, seg_idx, 0 AS win, start AS ws, "end" AS we FROM g WHERE seg_idx = 0 UNION ALL
      SELECT rec_id, seg_idx, CASE WHEN ok THEN win ELSE win + 1 END, CASE WHEN ok THEN ws ELSE s0 END, CASE WHEN ok THEN greatest(we, s1) ELSE s1 END
      FROM (SELECT s.rec_id, s.seg_idx, s.start AS s0, s."end" AS s1, w.win, w.ws, w.we, s."end" - w.ws <= {span} + 1e-9{near} AS ok FROM w JOIN g s ON s.rec_id = w.rec_id AND s.seg_idx = w.seg_idx + 1))
    SELECT rec_id, win, min(ws) AS start, max(we) AS "end", CAST(count(*) AS INTEGER) AS rows FROM w GROUP BY 1, 2"""


@query(
    _span_sql(20.0, 1.5)
)
def win_review_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, lambda rows: folds.span_windows(rows, 20.0, 1.5), "rec_id long, win int, start double, end double, rows int")


@query(
    _span_sql(90.0, None)
)
def win_lexical_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, lambda rows: folds.span_windows(rows, 90.0, None), "rec_id long, win int, start double, end double, rows int")


@query(
    """WITH RECURSIVE g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY seg_idx) AS k FROM segments WHERE speaker IS NOT NULL),
    w AS (SELECT rec_id, k, 0 AS turn, speaker, start AS ws, "end" AS we FROM g WHERE k = 1 UNION ALL
      SELECT rec_id, k, CASE WHEN ok THEN turn ELSE turn + 1 END, speaker, CASE WHEN ok THEN ws ELSE s0 END, s1
      FROM (SELECT s.rec_id, s.k, s.speaker, s.start AS s0, s."end" AS s1, w.turn, w.ws, w.speaker = s.speaker AND s.start - w.we < 1.2 AND s."end" - w.ws <= 20 + 1e-9 AS ok FROM w JOIN g s ON s.rec_id = w.rec_id AND s.k = w.k + 1))
    SELECT rec_id, turn, speaker, min(ws) AS start, arg_max(we, k) AS "end", CAST(count(*) AS INTEGER) AS rows FROM w GROUP BY 1, 2, 3"""
)
def win_ui_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, lambda rows: folds.block_turns(rows, 1.2, 20.0), "rec_id long, turn int, speaker string, start double, end double, rows int")


@query(
    """WITH RECURSIVE g AS MATERIALIZED (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY seg_idx) AS k, length(coalesce(text, '')) AS n FROM turns),
    w AS (SELECT rec_id, k, 0 AS chunk, n AS chars FROM g WHERE k = 1 UNION ALL
      SELECT s.rec_id, s.k, CASE WHEN w.chars + s.n <= 200 THEN chunk ELSE chunk + 1 END, CASE WHEN w.chars + s.n <= 200 THEN w.chars + s.n ELSE s.n END FROM w JOIN g s ON s.rec_id = w.rec_id AND s.k = w.k + 1)
    SELECT rec_id, chunk, CAST(max(chars) AS INTEGER) AS chars, CAST(count(*) AS INTEGER) AS rows FROM w GROUP BY 1, 2"""
)
def win_chunk_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations are short, so the chunks are as well."""
    return folds.grouped(turns(spark, sf_dir), lambda rows: folds.chunk_texts(rows, 200), "rec_id long, chunk int, chars int, rows int")


@query()
def iv_split_merge_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, lambda rows: folds.speech_chunks(rows, 5.0, 0.75), "rec_id long, chunk int, start double, end double")


@query(
    """WITH RECURSIVE g AS MATERIALIZED (SELECT rec_id, seg_idx, start, "end", CASE WHEN event_id % 4 = 0 THEN ' 嗯' ELSE text END AS text FROM segments),
    w AS (SELECT rec_id, seg_idx, seg_idx AS head, start, "end", text FROM g WHERE seg_idx = 0 UNION ALL
      SELECT rec_id, i, CASE WHEN ok THEN head ELSE i END, CASE WHEN ok THEN s0 ELSE t0 END, t1, CASE WHEN ok THEN s || trim(t) ELSE t END
      FROM (SELECT g.rec_id, g.seg_idx AS i, w.head, w.start AS s0, g.start AS t0, g."end" AS t1, w.text AS s, g.text AS t, length(trim(g.text)) = 1 AND g."end" - g.start <= 1.2 AND g.start - w."end" <= 0.8 AND length(w.text) >= 8 AS ok
        FROM w JOIN g ON g.rec_id = w.rec_id AND g.seg_idx = w.seg_idx + 1))
    SELECT rec_id, head AS seg_idx, min(start) AS start, arg_max("end", w.seg_idx) AS "end", arg_max(text, w.seg_idx) AS text FROM w GROUP BY 1, 2"""
)
def win_merge_single_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth text is a single character."""
    s = segments(spark, sf_dir).withColumn("text", F.expr("CASE WHEN event_id % 4 = 0 THEN ' 嗯' ELSE text END")).select("rec_id", "seg_idx", "start", "end", "text")
    return folds.grouped(s, lambda rows: folds.merge_fragments(rows, 1.2, 0.8, 8), "rec_id long, seg_idx int, start double, end double, text string")


@query(
    """WITH a AS (SELECT rec_id, seg_idx, event_type AS t FROM segments JOIN events USING (event_id)), n AS (SELECT *, CASE WHEN t = lag(t) OVER (PARTITION BY rec_id ORDER BY seg_idx) THEN 0 ELSE 1 END AS new FROM a),
    i AS (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY seg_idx) AS i FROM n), k AS (SELECT rec_id, seg_idx, row_number() OVER (PARTITION BY rec_id, i ORDER BY seg_idx) - 1 AS k, count(*) OVER (PARTITION BY rec_id, i) AS n FROM i)
    SELECT rec_id, seg_idx FROM k WHERE k % 3 <> 0 AND k - k % 3 + 2 < n"""
)
def flt_similar_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are the types of events, of which no two are alike."""
    kinds = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("text"))
    return layers.like_triples(segments(spark, sf_dir).drop("text").join(kinds, "event_id")).where("repeats").select("rec_id", "seg_idx")


@query(
    """WITH h AS (SELECT *, contains(regexp_replace(trim(text), '[，。！？,.!? ]+$', ''), '嗯') OR contains(regexp_replace(trim(text), '[，。！？,.!? ]+$', ''), 'view 1') AS hit FROM segments),
    n AS (SELECT *, coalesce(lag(hit) OVER w, false) OR coalesce(lead(hit) OVER w, false) AS beside, start - coalesce(lag("end") OVER w, 0) AS before, coalesce(lead(start) OVER w - "end", 999) AS after
      FROM h WINDOW w AS (PARTITION BY rec_id ORDER BY seg_idx)) SELECT rec_id, seg_idx FROM n WHERE hit AND (beside OR before >= 1 OR after >= 1)"""
)
def flt_weak_phrase_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return s.withColumn("gone", layers.weak_phrase(s, ("嗯", "view 1"), 1.0)).where("gone").select("rec_id", "seg_idx")


@query(
    """WITH RECURSIVE g AS MATERIALIZED (SELECT rec_id, seg_idx, start, row_number() OVER (PARTITION BY rec_id ORDER BY value DESC, start, seg_idx) AS k FROM segments),
    w AS (SELECT rec_id, k, seg_idx, true AS fits, [start] AS chosen FROM g WHERE k = 1 UNION ALL
      SELECT rec_id, k, seg_idx, ok, CASE WHEN ok THEN list_append(chosen, start) ELSE chosen END
      FROM (SELECT g.rec_id, g.k, g.seg_idx, g.start, w.chosen, len(w.chosen) < 24 AND len(list_filter(w.chosen, lambda c: abs(g.start - c) < 3.0)) = 0 AS ok FROM w JOIN g ON g.rec_id = w.rec_id AND g.k = w.k + 1))
    SELECT rec_id, CAST(len(chosen) - 1 AS INTEGER) AS place, seg_idx FROM w WHERE fits"""
)
def topk_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fold(spark, sf_dir, lambda rows: folds.spaced(rows, 3.0, 24), "rec_id long, place int, seg_idx int")


@query(f"WITH RECURSIVE {_ASSIGN} SELECT rec_id, pred, ref FROM mapped")
def vec_hungarian(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = iv.pair_seconds(iv.active_sets(*_sides(spark, sf_dir)))

    def assign(rows: list[dict]) -> list[dict]:
        return [{"pred": a, "ref": b} for a, b in folds.best_assignment({(r["pred"], r["ref"]): r["seconds"] for r in rows}).items()]

    return folds.grouped(pairs, assign, "rec_id long, pred string, ref string", order=("pred", "ref"))


@query()
def vec_eigengap(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.expr("vec_id % 5").alias("rec_id"), F.col("vec_id").alias("seg_idx"), "embedding")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        rec, rows = pdf["rec_id"].iloc[0], np.stack(pdf.sort_values("seg_idx")["embedding"].to_list())
        k, gap = folds.eigengap(rows)
        return pd.DataFrame({"rec_id": [rec], "speakers": [k], "gap": [round(gap, 6)]})

    return v.groupBy("rec_id").applyInPandas(count, "rec_id long, speakers int, gap double")


# Integrity

_CHECKS = """n AS (SELECT *, lag(start) OVER w AS ps, lag("end") OVER w AS pe FROM segments WINDOW w AS (PARTITION BY rec_id ORDER BY seg_idx)),
    v AS (SELECT rec_id, seg_idx, unnest(list_filter([CASE WHEN start < 0 THEN 'negative' END, CASE WHEN "end" <= start THEN 'not_positive' END, CASE WHEN start < ps THEN 'start_falls' END, CASE WHEN "end" < pe THEN 'end_falls' END,
      CASE WHEN pe - start > 0.05 THEN 'overlap' END, CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN speaker IS NULL THEN 'no_speaker' END], lambda x: x IS NOT NULL)) AS code FROM n)"""


@query(f"WITH {_CHECKS} SELECT * FROM v")
def ig_transcript_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.violations(segments(spark, sf_dir))


@query(f"WITH {_CHECKS} SELECT code, count(*) AS n FROM v GROUP BY 1")
def ig_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.violations(segments(spark, sf_dir)).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT rec_id, seg_idx FROM segments WHERE event_id % 9 = 0")
def ig_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("rec_id", "seg_idx", "start", "end", "text", "event_id")
    changed = s.withColumn("text", F.when(F.expr("event_id % 9 = 0"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return integrity.geometry(s, changed)


@query(
    """WITH o AS (SELECT a.rec_id, a.seg_idx, count(b.seg_idx) AS others FROM segments a LEFT JOIN segments b ON b.rec_id = a.rec_id AND b.seg_idx <> a.seg_idx AND (b.start + b."end") / 2 <= a."end" + 1e-6 AND b.start >= a.start - 1e-6
      AND b.start < a."end" GROUP BY 1, 2), p AS (SELECT a.rec_id, a.seg_idx, count(b.seg_idx) AS others FROM segments a LEFT JOIN segments b ON b.rec_id = a.rec_id AND b.seg_idx <> a.seg_idx AND b."end" <= a."end" + 1e-6
      AND (b.start + b."end") / 2 >= a.start - 1e-6 AND b."end" > a.start GROUP BY 1, 2)
    SELECT s.rec_id, s.seg_idx, s.event_id % 11 <> 0 AND s.event_id % 13 <> 0 AND o.others = 0 AND p.others = 0 AS preserved FROM segments s JOIN o ON s.rec_id = o.rec_id AND s.seg_idx = o.seg_idx JOIN p ON s.rec_id = p.rec_id AND s.seg_idx = p.seg_idx"""
)
def ig_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment against its halves, of which some have lost a character or end too early, and its neighbours' that lie in it."""
    s = segments(spark, sf_dir)
    mid, half = (F.col("start") + F.col("end")) / 2, F.floor(F.length("text") / 2).cast("int")
    left = s.select("rec_id", "start", F.when(F.expr("event_id % 13 = 0"), mid - 0.01).otherwise(mid).alias("end"), F.left("text", half).alias("text"))
    right = F.expr("substring(text, CAST(floor(length(text) / 2) AS INT) + 1 + CAST(event_id % 11 = 0 AS INT))")
    right = s.select("rec_id", mid.alias("start"), "end", right.alias("text"))
    return integrity.partitions(s.select("rec_id", "seg_idx", "start", "end", "text"), left.unionByName(right))


@query("""SELECT rec_id, sha256(string_agg('s:' || format('{:.6f}', start) || ':' || format('{:.6f}', "end"), '|' ORDER BY seg_idx)) AS sha256 FROM segments GROUP BY 1""")
def ig_timeline_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.timeline_hash(segments(spark, sf_dir))


@query("SELECT rec_id, bool_and(speaker IS NOT NULL) AS complete FROM segments GROUP BY 1")
def ig_complete_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.complete_labels(segments(spark, sf_dir))


# Readers, on the tables' own texts


@query("SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", timeline=False)
def scan_segment_dicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query('SELECT CAST(rec_id AS VARCHAR) AS uri, start, "end", speaker FROM segments WHERE speaker IS NOT NULL')
def scan_annotation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    docs = s.groupBy("rec_id").agg(F.to_json(F.struct(F.collect_list(F.struct("start", "end", "text", "speaker")).alias("segments"))).alias("value"))
    return readers.annotations(docs, "rec_id")


@query('SELECT CAST(rec_id AS VARCHAR) AS uri, round(start, 3) AS start, round("end", 3) AS "end", speaker FROM segments WHERE speaker IS NOT NULL')
def scan_rttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).where("speaker IS NOT NULL")
    line = F.format_string("SPEAKER %d 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.col("rec_id"), F.col("start"), F.col("end") - F.col("start"), F.col("speaker"))
    r = readers.rttm(s.select(line.alias("value")))
    return r.select("uri", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "speaker")


@query(
    """WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS term, unnest(range(0, len(string_split(text, ' ')))) AS i FROM (SELECT item_id, regexp_replace(replace(text, ',', ''), '\\s+', ' ', 'g') AS text FROM benchmark)),
    f AS (SELECT item_id, term, min(i) AS i FROM w WHERE term <> '' AND length(term) <= 48 GROUP BY 1, 2) SELECT item_id, term, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) AS INTEGER) AS place FROM f""",
    timeline=False,
)
def scan_hotwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    text = F.regexp_replace(F.regexp_replace(F.replace("text", F.lit(","), F.lit("")), r"\s+", " "), " ", ",")
    return readers.terms(b.select("item_id", text.alias("value")), "item_id")


@query("SELECT page_id, 'p' || page_id AS title, md5(html) AS body FROM pages", timeline=False)
def scan_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("value", F.concat(F.lit("---\ntitle: p"), F.col("page_id"), F.lit("\nkind: page\n---\n"), F.col("html")))
    fields, body = readers.frontmatter("value")
    return p.select("page_id", fields["title"].alias("title"), F.md5(body).alias("body"))
