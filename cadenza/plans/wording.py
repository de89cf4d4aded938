"""Queries over terms, rewrites, evidence and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators import folds, select, terms
from cadenza.operators import intervals as iv
from cadenza.operators import review as rv
from cadenza.operators import runs as rn
from cadenza.operators.integrity import violations
from cadenza.plans.registry import query
from cadenza.plans.scores import _RUNS, _bench
from cadenza.sources.adapters import ranges, segments, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _part(k: int, of: int = 101):
    return F.expr(f"(event_id * {k} % {of}) / 100")


_P = "s AS (SELECT event_id, (event_id * 7 % 101) / 100 AS a, (event_id * 11 % 101) / 100 AS b, (event_id * 13 % 101) / 100 AS c, (event_id * 17 % 101) / 100 AS d, (event_id * 19 % 101) / 1000 AS e FROM events)"


@query(
    f"""WITH {_P} SELECT event_id, CASE WHEN a < 0.5 AND b < 0.5 THEN 'severe_low_similarity' WHEN c >= 0.78 AND (a + b) / 2 <= 0.72 THEN 'auxiliary_consensus' WHEN a >= 0.85 AND b >= 0.85 AND c >= 0.85 THEN 'consistent' ELSE 'review' END AS verdict FROM s""",
    timeline=False,
)
def co_audit_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", terms.audit(_part(7), _part(11), _part(13)).alias("verdict"))


@query(
    f"""WITH {_P}, h AS (SELECT *, d >= 0.30 AND c >= 0.15 AND e < 0.08 AS heard FROM s) SELECT event_id, CASE WHEN heard AND ((a >= 0.72 AND b >= 0.06) OR (a >= 0.67 AND b >= 0.12 AND c >= 0.5)) THEN 'assign' WHEN heard AND a >= 0.64 THEN 'review' ELSE 'insufficient' END AS decision FROM h""",
    timeline=False,
)
def vec_cue_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    overlap = F.expr("(event_id * 19 % 101) / 1000")
    return _events(spark, sf_dir).select("event_id", terms.cue_evidence(_part(7), _part(11), _part(13), _part(17), overlap).alias("decision"))


@query(
    """WITH p AS (SELECT event_id, 100 + event_id * 31 % 140 AS p, 100 + event_id * 7 % 140 AS s, 100 + event_id * 13 % 140 AS t FROM events)
    SELECT event_id, abs(p - t) - abs(p - s) > 18 AND least(s, t) < 155 AND greatest(s, t) > 185 AND greatest(s, t) - least(s, t) >= 45 AS blocked FROM p""",
    timeline=False,
)
def dz_voice_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda k: F.expr(f"100 + event_id * {k} % 140")
    return _events(spark, sf_dir).select("event_id", terms.voice_blocks(of(31), of(7), of(13)).alias("blocked"))


#: What a model recommends for each candidate: mixed for even users, mostly 2 for odd ones.
_MODEL_N = "CASE WHEN user_id % 2 = 0 THEN event_id % 4 WHEN event_id % 5 = 0 THEN 3 ELSE 2 END"


@query(
    f"""WITH c AS (SELECT user_id AS rec_id, 2 + event_id % 5 AS k, {_MODEL_N} AS model FROM events), m AS (SELECT DISTINCT rec_id, model FROM c)
    SELECT m.rec_id, m.model, count(c.k) FILTER (c.model = m.model) AS votes, count(c.k) AS compatible,
      m.model > 0 AND count(c.k) > 0 AND count(c.k) FILTER (c.model = m.model) >= greatest(2, floor(0.6 * count(c.k))) AS consistent
    FROM m LEFT JOIN c ON m.rec_id = c.rec_id AND c.k >= greatest(2, m.model) GROUP BY 1, 2""",
    timeline=False,
)
def dz_guard_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _events(spark, sf_dir).selectExpr("user_id AS rec_id", "2 + event_id % 5 AS k", f"{_MODEL_N} AS model")
    return rv.consistent_recommendations(c)


@query(
    """WITH p AS (SELECT event_id, event_type AS a, event_type || 's' AS b FROM events) SELECT event_id, length(a) >= 3 AND substr(a || 'x', 2) = left(substr(a, 2) || 'xy', length(a)) AS fragment FROM p""",
    timeline=False,
)
def al_sliding_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.concat("event_type", F.lit("x"))
    b = F.concat(F.substring("event_type", 2, 100), F.lit("xy"))
    return _events(spark, sf_dir).select("event_id", terms.sliding_fragment(a, b).alias("fragment"))


@query(
    """WITH n AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM conversations),
    p AS (SELECT conv_id, turn, substr(text, 1, 12) AS l, substr(text, 13, 4) AS m, substr(text, 17, 12) AS r, CASE WHEN turn % 2 = 0 THEN substr(text, 1 + turn * 3, 30) ELSE coalesce(other, '') END AS o FROM n)
    SELECT conv_id, turn, len(list_filter(range(3, 6), lambda k: contains(o, right(l, k) || m || left(r, k)))) > 0 AS confirmed FROM p""",
    timeline=False,
)
def co_confirm_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A piece of each turn with its context, looked up in a later cut of the same turn or in the next turn."""
    n = table(spark, sf_dir, "conversations").withColumn("other", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")))
    other = F.expr("CASE WHEN turn % 2 = 0 THEN substr(text, CAST(1 + turn * 3 AS INT), 30) ELSE coalesce(other, '') END")
    found = terms.confirmed(other, F.substring("text", 1, 12), F.substring("text", 13, 4), F.substring("text", 17, 12), 3, 5)
    return n.select("conv_id", "turn", found.alias("confirmed"))


@query()
def al_term_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.near_terms(terms.occurrences(table(spark, sf_dir, "conversations").withColumn("row", F.concat_ws(":", "conv_id", "turn")), "row"), "row")


@query("SELECT term, count(*) AS n, count(DISTINCT item_id) AS rows FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '\\p{L}{4,}')) AS term FROM benchmark) GROUP BY 1", timeline=False)
def agg_term_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = terms.occurrences(table(spark, sf_dir, "benchmark"), "item_id")
    return occ.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("rows"))


@query()
def topk_hotword_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("thation",), ("enting",), ("oution",)], "term string")
    return terms.hotword_candidates(table(spark, sf_dir, "benchmark"), "item_id", wanted, letter="[^\\W\\d_]")  # its texts aren't Chinese


@query(
    f"""WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY audio ORDER BY risk, strong, review, rtf, id, backend, part) AS r FROM b), w AS (SELECT * FROM r WHERE r = 1),
    f AS (SELECT audio, min((risk, strong, review, rtf)) AS raw FROM b WHERE backend = 1 GROUP BY 1)
    SELECT w.audio, CASE WHEN w.strong >= 5 AND f.raw IS NOT NULL THEN 1 ELSE w.backend END AS backend FROM w LEFT JOIN f ON w.audio = f.audio""",
    timeline=False,
)
def sort_preflight_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bench(spark, sf_dir)
    best = select.top_per(b, ["audio"], ["risk", "strong", "review", "rtf", "id", "backend", "part"], 1)
    safe = b.where("backend = 1").select(F.col("audio").alias("a")).distinct()
    rows = best.join(safe, F.col("audio") == F.col("a"), "left")
    return rows.select("audio", F.when((F.col("strong") >= 5) & F.col("a").isNotNull(), 1).otherwise(F.col("backend")).cast("int").alias("backend"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 1 ELSE 0 END + l_discount * 10 AS penalty FROM lineitem", timeline=False)
def sort_score_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.expr("CASE WHEN l_quantity < 10 THEN 1 ELSE 0 END") + F.col("l_discount") * 10).alias("penalty"))


@query(
    """WITH n AS (SELECT *, lag(start) OVER w AS ps, lag("end") OVER w AS pe FROM segments WINDOW w AS (PARTITION BY rec_id ORDER BY seg_idx)),
    a AS (SELECT rec_id, 'overlap' AS code FROM n WHERE pe - start > 0.05 UNION ALL SELECT rec_id, 'no_speaker' FROM n WHERE speaker IS NULL UNION ALL SELECT rec_id, 'end_falls' FROM n WHERE "end" < pe),
    b AS (SELECT rec_id, 'overlap' AS code FROM n WHERE pe - start > 0.05 UNION ALL SELECT rec_id, 'end_falls' FROM n WHERE "end" < pe)
    SELECT rec_id, code, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY 1, 2"""
)
def ig_freeze_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    candidate, baseline = violations(s).select("rec_id", "code"), violations(s.withColumn("speaker", F.coalesce("speaker", F.lit("x")))).select("rec_id", "code")
    _, new = select.multiset_difference(candidate, baseline)
    return new.groupBy("rec_id", "code").agg(F.count("*").alias("n"))


@query("SELECT rec_id, seg_idx, text, text || '!' AS corrected FROM segments WHERE event_id % 5 = 0")
def sink_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("corrected", F.expr("CASE WHEN event_id % 5 = 0 THEN concat(text, '!') ELSE text END"))
    return s.where("corrected <> text").select("rec_id", "seg_idx", "text", "corrected")


@query("SELECT rec_id, seg_idx, regexp_matches(text, '[0-9]') AND NOT regexp_matches(predicted, '[0-9]') AS rendered FROM segments")
def str_number_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("rec_id", "seg_idx", (F.col("text").rlike("[0-9]") & ~F.col("predicted").rlike("[0-9]")).alias("rendered"))


@query("SELECT doc_id, CASE WHEN contains(text, ' the ') THEN CAST(strpos(text, ' the ') - 1 AS INTEGER) ELSE -1 END AS pos FROM documents", timeline=False)
def str_handoff_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.regexp_instr("text", F.lit(" the ")) - 1).alias("pos")).withColumn("pos", F.greatest("pos", F.lit(-1)))


@query("SELECT rec_id, predicted AS speaker, round_even(sum(value), 3) AS value FROM segments GROUP BY 1, 2")
def map_votes_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = segments(spark, sf_dir).groupBy("rec_id", "predicted").agg(F.round(F.sum("value"), 6).alias("v"))
    votes = per.groupBy("rec_id").agg(F.map_from_entries(F.collect_list(F.struct("predicted", "v"))).alias("votes"))
    return votes.select("rec_id", F.explode(F.transform_values("votes", lambda k, v: F.bround(v, 3))).alias("speaker", "value"))


@query("SELECT rec_id, seg_idx, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY length(text) DESC, seg_idx) AS INTEGER) AS place FROM segments QUALIFY place <= 5")
def topk_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("rec_id", "seg_idx", "text")
    return select.ranked(s, ["rec_id"], [F.desc(F.length("text")), "seg_idx"], "place").where("place <= 5").select("rec_id", "seg_idx", "place")


@query()
def topk_review_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best first, overlapping no chosen one by 45 % of the shorter."""

    def pick(rows: list[dict]) -> list[dict]:
        chosen: list[dict] = []
        for r in sorted(rows, key=lambda x: (-x["value"], x["seg_idx"])):
            shared = lambda c, r=r: min(r["end"], c["end"]) - max(r["start"], c["start"])
            if len(chosen) < 8 and all(shared(c) < 0.45 * min(r["end"] - r["start"], c["end"] - c["start"]) for c in chosen):
                chosen.append(r)
        return [{"place": i, "seg_idx": r["seg_idx"]} for i, r in enumerate(chosen)]

    s = segments(spark, sf_dir).select("rec_id", "seg_idx", "start", "end", "value")
    return folds.grouped(s, pick, "rec_id long, place int, seg_idx int")


@query()
def iv_vad_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near ranges joined, then joined forward up to a limit, then long ones cut into equal parts."""

    def regions(rows: list[dict]) -> list[dict]:
        near: list[list[float]] = []
        for r in rows:
            if near and r["start"] - near[-1][1] < 0.6:
                near[-1][1] = max(near[-1][1], r["end"])
            else:
                near.append([r["start"], r["end"]])
        wide: list[list[float]] = []
        for s, e in near:
            if wide and s - wide[-1][1] < 3 and e - wide[-1][0] <= 25:
                wide[-1][1] = e
            else:
                wide.append([s, e])
        out = []
        for s, e in wide:
            n = max(1, int(-(-(e - s) // 25)))
            out += [{"start": s + (e - s) * i / n, "end": s + (e - s) * (i + 1) / n} for i in range(n)]
        return [{"region": i, **r} for i, r in enumerate(out)]

    return folds.grouped(ranges(spark, sf_dir), regions, "rec_id long, region int, start double, end double", order=("start", "end"))


@query(
    """WITH t AS (SELECT rec_id, seg_idx, start, "end" FROM segments), c AS (SELECT s.rec_id, s.start AS time FROM (SELECT *, lag(speaker) OVER (PARTITION BY rec_id ORDER BY seg_idx) AS p FROM segments WHERE speaker IS NOT NULL) s WHERE p <> speaker)
    SELECT t.rec_id, t.seg_idx, count(*) AS changes FROM t JOIN c ON c.rec_id = t.rec_id AND c.time > t.start + 0.2 AND c.time < t."end" - 0.2 GROUP BY 1, 2"""
)
def rv_subsegment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    inner = s.select("rec_id", "seg_idx", (F.col("start") + 0.2).alias("start"), (F.col("end") - 0.2).alias("end")).where("end > start")
    points = rn.change_points(s).select("rec_id", F.col("time").alias("start"), F.col("time").alias("end"))
    return iv.overlap_join(inner, points).groupBy("rec_id", "seg_idx").agg(F.count("*").alias("changes"))


@query("SELECT s.rec_id, s.seg_idx, s.text, CASE WHEN s.speaker IS NULL THEN 'no speaker' END AS review FROM segments s")
def rv_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("rec_id", "seg_idx", "text", "speaker")
    items = s.where("speaker IS NULL").select("rec_id", "seg_idx", F.lit("no speaker").alias("review"))
    return s.select("rec_id", "seg_idx", "text").join(items, ["rec_id", "seg_idx"], "left")
