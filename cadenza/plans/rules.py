"""Queries over small rules, guards of the number of speakers, further exports and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.operators import guards, integrity, rules
from cadenza.operators import intervals as iv
from cadenza.plans.registry import query
from cadenza.plans.texts import _clock
from cadenza.sources import readers, writers
from cadenza.sources.adapters import ranges, segments, table

# Exports with speakers


@query(f"""SELECT rec_id, string_agg('[' || {_clock('start')} || ' - ' || {_clock('"end"')} || '] ' || CASE WHEN speaker IS NULL THEN '' ELSE '[' || speaker || '] ' END || trim(text), chr(10) ORDER BY seg_idx) || chr(10) AS content FROM segments WHERE trim(text) <> '' GROUP BY 1""")
def sink_txt_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.txt(writers.named(segments(spark, sf_dir)))


@query(
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY seg_idx) AS k FROM segments WHERE trim(text) <> '')
    SELECT rec_id, string_agg(k || chr(10) || {_clock('start', ',')} || ' --> ' || {_clock('"end"', ',')} || chr(10) || CASE WHEN speaker IS NULL THEN '' ELSE '[' || speaker || '] ' END || trim(text) || chr(10), chr(10) ORDER BY seg_idx) AS content FROM n GROUP BY 1"""
)
def sink_srt_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.srt(writers.named(segments(spark, sf_dir)))


_JSON = """'{"segments":[' || string_agg('{"seg_idx":' || seg_idx || ',"start":' || CAST(start AS DOUBLE) || ',"end":' || CAST("end" AS DOUBLE) || ',"text":"' || text || '"' || CASE WHEN speaker IS NULL THEN '' ELSE ',"speaker":"' || speaker || '"' END || '}', ',' ORDER BY seg_idx) || ']}'"""


@query(f"SELECT rec_id, {_JSON} AS content FROM segments GROUP BY 1")
def sink_json_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.document(segments(spark, sf_dir), "seg_idx", "start", "end", "text", "speaker")


@query("""SELECT rec_id, '{"segments":[' || string_agg('{"seg_idx":' || seg_idx || ',"text":"' || text || '"}', ',' ORDER BY seg_idx) || ']}' AS content FROM segments GROUP BY 1""")
def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.document(segments(spark, sf_dir), "seg_idx", "text")


@query("SELECT rec_id, 'seg_idx' || chr(9) || 'speaker' || chr(9) || 'text' || chr(10) || string_agg(seg_idx || chr(9) || coalesce(speaker, '') || chr(9) || text, chr(10) ORDER BY seg_idx) AS content FROM segments GROUP BY 1")
def sink_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.tsv(segments(spark, sf_dir), "seg_idx", "speaker", "text")


@query(
    """WITH n AS (SELECT *, lag(speaker) OVER w AS p, row_number() OVER w AS k FROM segments WINDOW w AS (PARTITION BY rec_id ORDER BY seg_idx))
    SELECT rec_id, CAST(count(*) FILTER (k = 1 OR speaker IS DISTINCT FROM p) AS BIGINT) AS headings, CAST(count(*) AS BIGINT) AS anchors FROM n GROUP BY 1"""
)
def sink_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and anchors found again in the exported Markdown."""
    m = writers.markdown(segments(spark, sf_dir))
    return m.select("rec_id", F.regexp_count("content", F.lit("(?m)^## ")).cast("long").alias("headings"), F.regexp_count("content", F.lit('<a id="t-\\d+"></a>')).cast("long").alias("anchors"))


@query("SELECT rec_id, seg_idx, seg_idx % 5 <> 3 AS same FROM segments WHERE trim(text) <> ''")
def ig_export_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported lines, read again, against segments of which some were changed after the export."""
    s = segments(spark, sf_dir)
    changed = s.withColumn("text", F.when(F.expr("seg_idx % 5 = 3"), F.concat("text", F.lit("?"))).otherwise(F.col("text")))
    return integrity.exported_lines(writers.txt(s), changed)


# Reasons and texts

_PARTS = """['局部夹心跳变：甲', '推荐置信度不足：声线复核', '声线复核', '普通', '段内短声纹窗疑似换人，但证据重叠/接近：局部快速轮换风险', ' 强新发言开场 ', '']"""


@query(
    f"""WITH r AS (SELECT rec_id, seg_idx, array_to_string([{_PARTS}[1 + seg_idx % 7], {_PARTS}[1 + event_id % 7], {_PARTS}[1 + event_id // 7 % 7]], '；') AS reason FROM segments),
    p AS (SELECT *, list_filter(list_transform(string_split(reason, '；'), lambda x: trim(x)), lambda x: x <> '') AS p FROM r)
    SELECT rec_id, seg_idx, array_to_string(list_filter(p, lambda x: NOT (starts_with(x, '推荐置信度不足') OR starts_with(x, '段内短声纹窗疑似换人，但证据重叠/接近')) AND
      (contains(x, '局部夹心跳变') OR contains(x, '声线复核') OR contains(x, '强新发言开场') OR contains(x, '局部快速轮换风险'))), '；') AS reason FROM p"""
)
def flt_review_reason_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = "array('局部夹心跳变：甲', '推荐置信度不足：声线复核', '声线复核', '普通', '段内短声纹窗疑似换人，但证据重叠/接近：局部快速轮换风险', ' 强新发言开场 ', '')"
    reason = F.expr(f"concat_ws('；', {parts}[seg_idx % 7], {parts}[CAST(event_id % 7 AS INT)], {parts}[CAST(event_id div 7 % 7 AS INT)])")
    return segments(spark, sf_dir).select("rec_id", "seg_idx", rules.strong_reasons(reason).alias("reason"))


@query(
    """WITH r AS (SELECT rec_id, seg_idx // 5 AS item, list(CASE WHEN event_id % 6 = 0 THEN ' ' WHEN event_id % 6 = 1 THEN left(coalesce(speaker, ''), 3) ELSE coalesce(speaker, 'none') END ORDER BY seg_idx) AS r FROM segments GROUP BY 1, 2),
    f AS (SELECT rec_id, item, list_filter(list_transform(r, lambda x: trim(x)), lambda x: x <> '') AS r FROM r)
    SELECT rec_id, item, CASE WHEN len(r) = 0 THEN '' ELSE list_reduce(r, lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || '；' || x END) END AS reason FROM f"""
)
def set_merge_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("item", F.expr("seg_idx div 5"))
    said = F.expr("CASE WHEN event_id % 6 = 0 THEN ' ' WHEN event_id % 6 = 1 THEN left(coalesce(speaker, ''), 3) ELSE coalesce(speaker, 'none') END")
    rows = s.groupBy("rec_id", "item").agg(F.array_sort(F.collect_list(F.struct("seg_idx", said.alias("r")))).alias("x"))
    return rows.select("rec_id", "item", rules.merged_reasons(F.col("x.r")).alias("reason"))


@query("""SELECT conv_id, turn, md5(lower(regexp_replace(text, '[\\s，。！？、；：,.!?;:''"“”‘’()（）\\[\\]【】]+', '', 'g'))) AS text FROM conversations""", timeline=False)
def str_annotation_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(rules.annotation_norm("text")).alias("text"))


@query("""SELECT conv_id, turn, md5(regexp_replace(lower(text), '[\\p{P}\\p{Z}\\s]+', '', 'g')) AS text FROM conversations""", timeline=False)
def str_arena_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(rules.arena_norm("text")).alias("text"))


@query("""SELECT doc_id, md5(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g'))) AS text FROM documents""", timeline=False)
def str_public_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(rules.public_norm("text")).alias("text"))


@query(
    """WITH c AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS c, unnest(range(0, length(text))) AS i FROM conversations), k AS (SELECT * FROM c WHERE regexp_full_match(c, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}A-Za-z0-9]')),
    s AS (SELECT conv_id, turn, lower(string_agg(c, '' ORDER BY i)) AS stream, CAST(sum(i) AS BIGINT) AS places FROM k GROUP BY 1, 2)
    SELECT v.conv_id, v.turn, coalesce(stream, '') AS stream, coalesce(places, 0) AS places FROM conversations v LEFT JOIN s ON v.conv_id = s.conv_id AND v.turn = s.turn""",
    timeline=False,
)
def str_stream_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, places = rules.text_stream("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", stream.alias("stream"), F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x).alias("places"))


@query()
def str_soft_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("concat(repeat('我们今天一起来看这段话', 1 + CAST(event_id % 3 AS INT)), array('但是', '的就是', '然后', '对吧')[CAST(event_id % 4 AS INT)], repeat('大家都听见了', 1 + CAST(event_id % 2 AS INT)), CASE WHEN event_id % 5 = 0 THEN '，。！' ELSE '' END)")
    return segments(spark, sf_dir).withColumn("text", said).select("rec_id", "seg_idx", rules.soft_commas("text").alias("text"))


_LINES = "string_agg(CASE WHEN event_id % 3 = 0 THEN '[00:01] 作。' WHEN event_id % 5 = 0 THEN '[00:02] 他的工。' WHEN event_id % 7 = 0 THEN 'no time' ELSE '[00:03] 这个事情很好 ' || seg_idx END, chr(10) ORDER BY seg_idx)"


@query(
    f"""WITH t AS (SELECT rec_id, string_split({_LINES}, chr(10)) AS l FROM segments GROUP BY 1)
    SELECT rec_id, list_reduce(l, lambda a, x: CASE WHEN regexp_matches(x, '^\\[[^\\]]+\\]\\s*') AND regexp_matches(regexp_replace(x, '^\\[[^\\]]+\\]\\s*', ''), '[一-鿿]')
      AND length(trim(regexp_replace(x, '^\\[[^\\]]+\\]\\s*', ''), '。！？!?，,；;：:、 ')) <= 2 AND regexp_matches(regexp_extract(a, '[^\n]*$'), '的[工事话]|这[件]|那个|这个|团契|同工')
      THEN rtrim(regexp_replace(a, '\\s+$', ''), '。！？!?') || trim(regexp_replace(x, '^\\[[^\\]]+\\]\\s*', '')) ELSE a || chr(10) || x END) AS text FROM t"""
)
def win_join_wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("CASE WHEN event_id % 3 = 0 THEN '[00:01] 作。' WHEN event_id % 5 = 0 THEN '[00:02] 他的工。' WHEN event_id % 7 = 0 THEN 'no time' ELSE concat('[00:03] 这个事情很好 ', seg_idx) END")
    return writers.joined(segments(spark, sf_dir), line, "\n", "t").select("rec_id", rules.joined_lines("t").alias("text"))


@query("SELECT doc_id, count(*) AS mentions, count(DISTINCT m) AS kinds FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\d+(?:\\.\\d+)?\\s?(?:km|kg|cm|mm|m|g|%|s|h|元|米|公里|小时|分钟)')) AS m FROM documents) GROUP BY 1", timeline=False)
def str_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.measurements("text")).alias("m"))
    return found.groupBy("doc_id").agg(F.count("*").alias("mentions"), F.count_distinct("m").alias("kinds"))


@query(
    """WITH i AS (SELECT event_id, event_type, event_id % 4 AS k, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || ' g' END AS g FROM events)
    SELECT event_id, CASE WHEN k = 0 THEN event_type WHEN g <> '' THEN g ELSE event_type || ' t' END AS truth, CASE WHEN k = 0 THEN 'correct_text' WHEN g <> '' THEN 'gold_text' ELSE 'transcript' END AS source FROM i""",
    timeline=False,
)
def scan_gold_arena(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.expr("CASE WHEN event_id % 4 = 0 THEN map('correct_text', concat(' ', event_type), 'text', 'x') ELSE map('gold_text', CASE WHEN event_id % 3 = 0 THEN ' ' ELSE concat(event_type, ' g') END, 'transcript', concat(event_type, ' t')) END")
    e = table(spark, sf_dir, "events").withColumn("item", item)
    text, source = rules.gold_text(F.col("item"))
    return e.select("event_id", text.alias("truth"), source.alias("source"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'list' ELSE ['items', 'rows', 'segments'][1 + event_id % 4] END AS row_key, CAST(n AS INTEGER) AS place, event_type || n AS current_text FROM events, range(0, 2) r(n)", timeline=False)
def scan_gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = "concat('[{\"id\":\"1\",\"current_text\":\"', event_type, '0\"},{\"current_text\":\"', event_type, '1\"}]')"
    doc = F.expr(f"CASE WHEN event_id % 4 = 3 THEN {rows} ELSE concat('{{\"', array('items', 'rows', 'segments')[CAST(event_id % 4 AS INT)], '\":', {rows}, '}}') END")
    e = table(spark, sf_dir, "events").select("event_id", doc.alias("value"))
    return readers.gold_rows(e, "event_id").select("event_id", "row_key", "place", F.col("row.current_text").alias("current_text"))


@query("SELECT event_id, event_type || i || CASE WHEN i = 1 THEN '.wav' ELSE '.MP3' END AS audio FROM events, range(1, 3) r(i) WHERE i = 1 OR event_id % 2 = 0", timeline=False)
def scan_json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.expr("concat('{\"a\":{\"path\":\"', event_type, '1.wav\",\"n\":3},\"b\":[\"x\",', CASE WHEN event_id % 2 = 0 THEN concat('\"', event_type, '2.MP3\"') ELSE '\"y.txt\"' END, ']}')")
    return readers.audio_references(table(spark, sf_dir, "events").select("event_id", doc.alias("value")), "event_id")


_DOC = "SELECT rec_id, to_json(named_struct('uri', concat('r', rec_id), 'segments', x)) AS value FROM (SELECT rec_id, array_sort(collect_list(struct(start, `end`, text, speaker))) AS x FROM {s} GROUP BY rec_id)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of recordings as JSON texts."""
    return spark.sql(_DOC, s=segments(spark, sf_dir))


@query("""SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY start, "end") - 1 AS INTEGER) AS seg_idx, start, "end", text, speaker FROM segments""")
def scan_transcript_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.transcript_json(_documents(spark, sf_dir)).select("rec_id", "seg_idx", "s.start", "s.end", "s.text", "s.speaker")


@query("""SELECT 'r' || rec_id AS uri, start, "end", speaker FROM segments WHERE speaker IS NOT NULL""")
def scan_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.annotations(_documents(spark, sf_dir), "rec_id")


# Filters and joins


@query('SELECT rec_id, seg_idx FROM segments WHERE "end" - start >= 1.5')
def flt_exact_cue_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where(rules.embeddable("start", "end")).select("rec_id", "seg_idx")


@query("SELECT event_id, coalesce(event_id % 9 = 0, false) OR event_id % 7 = 0 OR (event_id % 5 <> 0 AND round((event_id * 3 % 100) / 1000, 6) > 0.02) AS risk FROM events", timeline=False)
def flt_anchor_overlap_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.expr("CASE WHEN event_id % 5 <> 0 THEN round((event_id * 3 % 100) / 1000, 6) END")
    flag, some = F.expr("CASE WHEN event_id % 9 = 0 THEN true WHEN event_id % 2 = 0 THEN false END"), F.expr("CASE WHEN event_id % 7 = 0 THEN 2 END")
    return table(spark, sf_dir, "events").select("event_id", rules.sample_risk(flag, some, ratio).alias("risk"))


@query(
    """WITH u AS (SELECT rec_id, seg_idx, "end" - start AS d, len(regexp_extract_all(repeat(text || ' ', 1 + event_id % 4), '[一-鿿]')) + len(regexp_extract_all(repeat(text || ' ', 1 + event_id % 4), '[A-Za-z0-9]+(?:[._+-][A-Za-z0-9]+)*')) AS n FROM segments)
    SELECT rec_id, seg_idx, n <= 2 OR d >= 0.65 OR n <= greatest(2, ceil(round(d * 12, 9))) AS plausible FROM u"""
)
def flt_review_plausible_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("text", F.expr("repeat(concat(text, ' '), CAST(1 + event_id % 4 AS INT))"))
    return s.select("rec_id", "seg_idx", rules.plausible_timing("text", "start", "end").alias("plausible"))


@query("""SELECT rec_id, seg_idx FROM segments WHERE speaker IS NOT NULL AND round("end" - start, 9) >= 1.5 AND length(regexp_replace(text, '[^一-鿿A-Za-z0-9]+', '', 'g')) >= 4""")
def flt_balanced_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.balanced(segments(spark, sf_dir).withColumn("case", F.col("speaker"))).select("rec_id", "seg_idx")


_UNION = """u0 AS (SELECT rec_id, start, "end", max("end") OVER (PARTITION BY rec_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranges),
    u1 AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY start, "end") AS g FROM u0), u AS (SELECT rec_id, min(start) AS start, max("end") AS "end" FROM u1 GROUP BY rec_id, g)"""


@query(
    f"""WITH {_UNION}, p AS (SELECT rec_id, seg_idx, greatest(0, start - 0.08) AS start, "end" + 0.08 AS "end" FROM segments),
    x AS (SELECT p.rec_id, p.seg_idx, p."end" - p.start AS d, coalesce(sum(CASE WHEN u.start IS NOT NULL THEN least(p."end", u."end") - greatest(p.start, u.start) END), 0) AS x
      FROM p LEFT JOIN u ON p.rec_id = u.rec_id AND u.start < p."end" AND u."end" > p.start GROUP BY ALL) SELECT rec_id, seg_idx, round(least(1, x / d), 9) AS ratio, CASE WHEN round(least(1, x / d), 9) <= 0.02 THEN 'clean' ELSE 'rejected' END AS side FROM x"""
)
def flt_partition_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    padded = s.withColumn("start", F.greatest(F.lit(0.0), F.col("start") - rules.SAMPLE_PADDING)).withColumn("end", F.col("end") + rules.SAMPLE_PADDING)
    r = iv.overlap_ratio(padded, ranges(spark, sf_dir), digits=9)
    return r.select("rec_id", "seg_idx", F.col("overlap_ratio").alias("ratio"), F.when(F.col("overlap_ratio") <= rules.SAMPLE_OVERLAP, "clean").otherwise("rejected").alias("side"))


@query(
    f"""WITH {_UNION}, w AS (SELECT rec_id, seg_idx AS win, start - 0.5 AS start, "end" + 0.5 AS "end" FROM segments),
    x AS (SELECT w.rec_id, w.win, w."end" - w.start AS d, coalesce(sum(CASE WHEN u.start IS NOT NULL THEN least(w."end", u."end") - greatest(w.start, u.start) END), 0) AS x
      FROM w LEFT JOIN u ON w.rec_id = u.rec_id AND u.start < w."end" AND u."end" > w.start GROUP BY ALL) SELECT rec_id, win, round(least(1, x / d), 6) AS ratio FROM x"""
)
def iv_overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = segments(spark, sf_dir).withColumn("start", F.col("start") - 0.5).withColumn("end", F.col("end") + 0.5)
    r = iv.overlap_ratio(w, ranges(spark, sf_dir), digits=6)
    return r.select("rec_id", F.col("seg_idx").alias("win"), F.col("overlap_ratio").alias("ratio"))


_LONG = """l AS (SELECT rec_id, seg_idx, start, CASE WHEN event_id % 6 = 0 THEN start + 9 ELSE "end" END AS "end", CASE WHEN event_id % 5 = 0 THEN ' 。，' WHEN event_id % 6 = 0 THEN '好的' ELSE text END AS text FROM segments WHERE true)"""


@query(
    f"""WITH few AS (SELECT rec_id, start + 1000 * (seg % 2) AS start, "end" + 1000 * (seg % 2) AS "end" FROM (SELECT *, CAST(start AS BIGINT) // 20 AS seg FROM ranges)), {_UNION.replace("FROM ranges", "FROM few")}, {_LONG},
    x AS (SELECT l.rec_id, l.seg_idx, l."end" - l.start AS d, l.text, round(coalesce(sum(CASE WHEN u.start IS NOT NULL THEN least(l."end", u."end") - greatest(l.start, u.start) END), 0), 9) AS heard
      FROM l LEFT JOIN u ON l.rec_id = u.rec_id AND u.start < l."end" AND u."end" > l.start GROUP BY ALL)
    SELECT rec_id, seg_idx, CASE WHEN rec_id NOT IN (SELECT rec_id FROM few) THEN text WHEN text = ' 。，' THEN '' WHEN round(d, 9) >= 8 AND length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) <= 6 AND heard <= 0.12 THEN '（非语音）' ELSE text END AS text FROM x"""
)
def flt_vad_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some segments last nine seconds and say two characters, some are marks alone; speech is found in every other stretch."""
    s = segments(spark, sf_dir)
    end = F.expr("CASE WHEN event_id % 6 = 0 THEN start + 9 ELSE end END")
    text = F.expr("CASE WHEN event_id % 5 = 0 THEN ' 。，' WHEN event_id % 6 = 0 THEN '好的' ELSE text END")
    s = s.select("rec_id", "seg_idx", "start", end.alias("end"), text.alias("text"))
    return rules.unsupported_text(s, _speech(spark, sf_dir)).select("rec_id", "seg_idx", "text")


def _speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speech ranges, every other twenty seconds of them moved far away."""
    moved = F.expr("1000 * (CAST(bround(start) AS BIGINT) div 20 % 2)")
    return ranges(spark, sf_dir).select("rec_id", (F.col("start") + moved).alias("start"), (F.col("end") + moved).alias("end"))


@query(
    f"""WITH few AS (SELECT rec_id, start + 1000 * (seg % 2) AS start, "end" + 1000 * (seg % 2) AS "end" FROM (SELECT *, CAST(start AS BIGINT) // 20 AS seg FROM ranges)), {_UNION.replace("FROM ranges", "FROM few")},
    x AS (SELECT s.rec_id, s.seg_idx AS cue_idx, round(s."end" - s.start, 9) AS d, length(regexp_replace(s.text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS n, s.event_id % 17 = 0 AS bad,
      round(coalesce(sum(CASE WHEN u.start IS NOT NULL THEN least(s."end", u."end") - greatest(s.start, u.start) END), 0), 9) AS heard
      FROM segments s LEFT JOIN u ON s.rec_id = u.rec_id AND u.start < s."end" AND u."end" > s.start GROUP BY ALL),
    r AS (SELECT rec_id, cue_idx, array_to_string(list_filter([CASE WHEN bad THEN 'collapsed_or_overlapping_boundary' END, CASE WHEN d >= 0.5 AND heard <= 0.08 AND heard / d <= 0.08 THEN 'no_vad_speech_support' END,
      CASE WHEN d >= 0.05 AND n >= 4 AND n / d > 12 THEN 'impossible_text_speed' END], lambda z: z IS NOT NULL), ',') AS reasons FROM x WHERE rec_id IN (SELECT rec_id FROM few)) SELECT * FROM r WHERE reasons <> ''"""
)
def flt_unreliable_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = segments(spark, sf_dir).select("rec_id", F.col("seg_idx").alias("cue_idx"), "start", "end", "text", F.expr("event_id % 17 <> 0").alias("reliable"))
    return rules.unreliable_cues(cues, _speech(spark, sf_dir))


_CUES = """q AS (SELECT rec_id, seg_idx, start, start + ("end" - start) * 0.4 AS "end", predicted AS speaker, 0 AS place FROM segments UNION ALL SELECT rec_id, seg_idx, start + ("end" - start) * 0.4, "end", event_type, 1 FROM segments JOIN events USING (event_id) WHERE event_id % 3 > 0)"""


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two speaker cues in most segments: the first two fifths and the rest."""
    s = segments(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    cut = F.expr("start + (end - start) * 0.4D")
    first = s.select("rec_id", "seg_idx", "start", cut.alias("end"), F.col("predicted").alias("speaker"), F.lit(0).alias("place"))
    return first.unionByName(s.where("event_id % 3 > 0").select("rec_id", "seg_idx", cut.alias("start"), "end", F.col("event_type").alias("speaker"), F.lit(1).alias("place")))


@query(
    f"""WITH {_CUES}, i AS (SELECT rec_id, seg_idx, k AS item, start + 0.9 * k AS start, start + 0.9 * k + 0.5 AS "end", speaker FROM segments, range(0, 4) r(k)),
    o AS (SELECT i.rec_id, i.seg_idx, i.item, q.speaker AS s, round(sum(least(i."end", q."end") - greatest(i.start, q.start)), 9) AS x FROM i JOIN q ON i.rec_id = q.rec_id AND i.seg_idx = q.seg_idx AND least(i."end", q."end") - greatest(i.start, q.start) > 0 GROUP BY 1, 2, 3, 4),
    b AS (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_idx, item ORDER BY x DESC, s DESC) AS k FROM o)
    SELECT i.rec_id, i.seg_idx, i.item, coalesce(b.s, i.speaker) AS label, CASE WHEN b.s IS NULL THEN 'segment' ELSE 'speaker_cue' END AS source FROM i LEFT JOIN b ON i.rec_id = b.rec_id AND i.seg_idx = b.seg_idx AND i.item = b.item AND b.k = 1"""
)
def join_sparse_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = segments(spark, sf_dir).select("rec_id", "seg_idx", "start", "speaker", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("item"))
    items = items.withColumn("start", F.col("start") + F.lit(0.9) * F.col("item")).withColumn("end", F.col("start") + 0.5)
    return rules.sparse_labels(items, _cues(spark, sf_dir))


@query(
    f"""WITH {_CUES}, c AS (SELECT rec_id, seg_idx, k AS cue_idx, start + ("end" - start) * k / 4 AS start, start + ("end" - start) * (k + 1) / 4 AS "end" FROM segments, range(0, 4) r(k)),
    m AS (SELECT c.rec_id, c.seg_idx, c.cue_idx, q.place, q.speaker, CASE WHEN q.place * 3 = c.cue_idx THEN 0 WHEN round(least(c."end", q."end") - greatest(c.start, q.start), 9) >= least(0.25, greatest(0.05, round((c."end" - c.start) * 0.5, 9))) THEN 1 END AS prio
      FROM c JOIN q ON c.rec_id = q.rec_id AND c.seg_idx = q.seg_idx),
    b AS (SELECT *, row_number() OVER (PARTITION BY rec_id, seg_idx, cue_idx ORDER BY prio, place, speaker) AS k FROM m WHERE prio IS NOT NULL)
    SELECT c.rec_id, c.seg_idx, c.cue_idx, b.speaker FROM c LEFT JOIN b ON c.rec_id = b.rec_id AND c.seg_idx = b.seg_idx AND c.cue_idx = b.cue_idx AND b.k = 1"""
)
def join_cue_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four cues in each segment; speaker cues name the first and the fourth."""
    s = segments(spark, sf_dir).select("rec_id", "seg_idx", "start", "end", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("cue_idx"))
    cues = s.select("rec_id", "seg_idx", "cue_idx", F.expr("start + (end - start) * cue_idx / 4").alias("start"), F.expr("start + (end - start) * (cue_idx + 1) / 4").alias("end"))
    return rules.cue_speakers(cues, _cues(spark, sf_dir).withColumn("cue_idx", (F.col("place") * 3).cast("long")))


@query(
    """WITH c AS (SELECT rec_id, seg_idx AS "check", CASE WHEN seg_idx % 10 > 0 THEN start - 1 END AS start, "end" + 4 AS "end", [event_type, 'purchase 1', '嗯'] AS terms FROM segments JOIN events USING (event_id) WHERE seg_idx < 12),
    t AS (SELECT c.rec_id, c."check", any_value(terms) AS terms, string_agg(s.text, ' ' ORDER BY s.seg_idx) AS t FROM c JOIN segments s ON c.rec_id = s.rec_id AND (c.start IS NULL OR (s."end" >= c.start AND s.start <= c."end")) GROUP BY 1, 2),
    p AS (SELECT *, list_min(list_filter(list_transform(terms, lambda x: instr(t, x)), lambda i: i > 0)) AS pos FROM t)
    SELECT rec_id, "check", pos IS NOT NULL AS hit, CASE WHEN pos IS NULL THEN left(t, 80) ELSE substr(t, greatest(0, pos - 29) + 1, pos + 71 - greatest(0, pos - 29)) END AS snippet FROM p"""
)
def proj_phrase_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording's first twelve rows are checks, of which some are on its whole text."""
    s = segments(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id").where("seg_idx < 12")
    start = F.expr("CASE WHEN seg_idx % 10 > 0 THEN start - 1 END")
    checks = s.select("rec_id", F.col("seg_idx").alias("check"), start.alias("start"), (F.col("end") + 4).alias("end"), F.array("event_type", F.lit("purchase 1"), F.lit("嗯")).alias("terms"))
    return rules.phrase_checks(checks, segments(spark, sf_dir))


# Aggregates and scalars


@query(
    """WITH r AS (SELECT event_type AS mode, CASE WHEN event_type = 'view' OR event_id % 5 = 0 THEN 'error' ELSE 'ok' END AS status, ['low', 'medium', 'unknown', 'high', 'odd'][1 + event_id % 3] AS risk_level, event_id % 7 AS strong, event_id % 11 AS review, event_id % 2 AS terms, length(event_type) AS chars, value AS rtf FROM events),
    g AS (SELECT mode, count(*) FILTER (status = 'ok') AS ok_count, count(*) FILTER (status <> 'ok') AS error_count, max(CASE risk_level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) FILTER (status = 'ok') AS risk, CAST(sum(strong) FILTER (status = 'ok') AS BIGINT) AS strong,
      CAST(sum(review) FILTER (status = 'ok') AS BIGINT) AS review, CAST(sum(terms) FILTER (status = 'ok') AS BIGINT) AS terms, CAST(sum(chars) FILTER (status = 'ok') AS BIGINT) AS chars, round(avg(rtf) FILTER (status = 'ok'), 6) AS avg_rtf FROM r GROUP BY 1)
    SELECT mode, CASE WHEN ok_count > 0 THEN 'ok' ELSE 'error' END AS status, ['low', 'medium', 'unknown', 'high'][risk + 1] AS risk_level, strong, review, terms, chars, avg_rtf, ok_count, error_count, CASE WHEN chars >= 10 THEN 0 ELSE 1 END AS sparse FROM g""",
    timeline=False,
)
def agg_preflight_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cols = {"mode": "event_type", "status": "CASE WHEN event_type = 'view' OR event_id % 5 = 0 THEN 'error' ELSE 'ok' END", "risk_level": "array('low', 'medium', 'unknown', 'high', 'odd')[CAST(event_id % 3 AS INT)]"}
    cols |= {"strong": "event_id % 7", "review": "event_id % 11", "terms": "event_id % 2", "chars": "length(event_type)", "rtf": "value"}
    return rules.mode_summary(e.selectExpr(*(f"{x} AS {c}" for c, x in cols.items())))


_BAND = "CASE (length(speaker) + rec_id) % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'mid' ELSE 'none' END"


@query(
    f"""WITH p AS (SELECT rec_id, speaker, {_BAND} AS band, arg_min(start, seg_idx) AS seen FROM segments WHERE speaker IS NOT NULL GROUP BY 1, 2)
    SELECT rec_id, speaker, CASE band WHEN 'low' THEN 'L' WHEN 'high' THEN 'H' WHEN 'mid' THEN 'M' ELSE 'U' END || row_number() OVER (PARTITION BY rec_id, band ORDER BY seen, speaker) AS line FROM p"""
)
def agg_voice_line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    profiles = s.where("speaker IS NOT NULL").select("rec_id", "speaker").distinct().withColumn("voice_band", F.expr(_BAND))
    return rules.voice_lines(profiles, s)


@query(
    """WITH d AS (SELECT rec_id, max("end") - CASE WHEN rec_id % 5 = 0 THEN max("end") WHEN rec_id % 3 = 0 THEN max("end") - 55 ELSE 0 END AS d FROM segments GROUP BY 1),
    a AS (SELECT rec_id, d, k, CASE WHEN d <= 60 THEN 0.0 ELSE least(greatest(d * [0.12, 0.5, 0.82][k] - 30, 0), greatest(d - 60, 0)) END AS s FROM d, range(1, 4) r(k) WHERE d > 60 OR k = 1),
    f AS (SELECT rec_id, round_even(s, 0) AS b, arg_min(s, k) AS s, max(d) AS d FROM a GROUP BY 1, 2) SELECT rec_id, round(s, 6) AS start, round(CASE WHEN d <= 0 THEN 60 ELSE least(60, d - s) END, 6) AS seconds FROM f"""
)
def win_preflight_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = segments(spark, sf_dir).groupBy("rec_id").agg(F.max("end").alias("e"))
    return rules.preflight_windows(d.select("rec_id", F.expr("e - CASE WHEN rec_id % 5 = 0 THEN e WHEN rec_id % 3 = 0 THEN e - 55 ELSE 0 END").alias("duration")), 60.0, 3)


@query("SELECT event_id, round(CASE WHEN event_id % 9 > 0 THEN value / (event_id % 9) ELSE 0 END, 6) AS rtf FROM events", timeline=False)
def mt_rtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(rules.real_time_factor(F.col("value"), F.expr("event_id % 9")), 6).alias("rtf"))


@query("SELECT event_id, CASE WHEN event_id % 6 > 0 AND event_id % 10 / 10 >= 0.35 THEN CAST(abs(event_id * 7 % 140 - event_id * 11 % 140) AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END AS distance FROM events", timeline=False)
def mt_profile_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pitch, profile = F.expr("CAST(event_id * 7 % 140 AS DOUBLE)"), F.expr("CASE WHEN event_id % 6 > 0 THEN CAST(event_id * 11 % 140 AS DOUBLE) END")
    return table(spark, sf_dir, "events").select("event_id", rules.profile_distance(pitch, profile, F.expr("event_id % 10 / 10")).alias("distance"))


# Guards: every event is a candidate of its user's recording

_CAND = """cand AS (SELECT user_id AS rec_id, event_id AS id, 2 + event_id % 7 AS k, 2 + event_id % 7 - (event_id % 11 = 0)::INT AS formed, 2 + event_id % 7 - (event_id % 13 = 0)::INT AS stable, (event_id % 5 = 0)::INT AS weak, (event_id % 17 = 0)::INT AS tiny,
      (event_id % 19 = 0)::INT AS fragmented, (event_id % 23 = 0)::INT AS marginal, event_id % 4 AS severe, event_id * 37 % 101 / 10 AS score, CASE WHEN user_id % 3 = 0 THEN 5 WHEN user_id % 3 = 1 THEN 4 ELSE 2 + event_id % 7 END AS model_n, event_id * 13 % 10 / 10 AS confidence,
      CASE WHEN event_id % 8 > 0 THEN event_id * 7 % 50 / 100 END AS selected_score, CASE WHEN event_id % 6 > 0 THEN event_id * 3 % 40 / 100 END AS recommended_score FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id) = 1)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(W.partitionBy("user_id", F.expr("event_id % 7")).orderBy("event_id"))).where("r = 1")
    bit = "CAST(event_id % {} = 0 AS INT)".format
    cols = {"rec_id": "user_id", "k": "2 + event_id % 7", "formed": f"2 + event_id % 7 - {bit(11)}", "stable": f"2 + event_id % 7 - {bit(13)}", "weak": bit(5), "tiny": bit(17), "fragmented": bit(19), "marginal": bit(23)}
    cols |= {"severe": "event_id % 4", "score": "event_id * 37 % 101 / 10", "model_n": "CASE WHEN user_id % 3 = 0 THEN 5 WHEN user_id % 3 = 1 THEN 4 ELSE 2 + event_id % 7 END", "confidence": "event_id * 13 % 10 / 10"}
    cols |= {"selected_score": "CASE WHEN event_id % 8 > 0 THEN event_id * 7 % 50 / 100 END", "recommended_score": "CASE WHEN event_id % 6 > 0 THEN event_id * 3 % 40 / 100 END"}
    return e.selectExpr(*(f"{x} AS {c}" for c, x in cols.items()))


_SUM = """summ AS (SELECT rec_id, k, i AS speaker, 3 + (id + i) % 9 AS segments, 15 + (id * 3 + i * 7) % 90 AS duration_s, (id + i) % 6 AS turns, (id + i * 5) % 5 AS stable_turns, (id + i) % 4 = 0 AS fragile, (id + i) % 20 / 100 AS segment_ratio FROM (SELECT *, unnest(range(1, formed + 1)) AS i FROM cand))"""


def _speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(W.partitionBy("user_id", F.expr("event_id % 7")).orderBy("event_id"))).where("r = 1")
    e = e.selectExpr("user_id AS rec_id", "event_id AS id", "2 + event_id % 7 AS k", "explode(sequence(1L, 2 + event_id % 7 - CAST(event_id % 11 = 0 AS INT))) AS i")
    return e.selectExpr("rec_id", "k", "i AS speaker", "3 + (id + i) % 9 AS segments", "15 + (id * 3 + i * 7) % 90 AS duration_s", "(id + i) % 6 AS turns", "(id + i * 5) % 5 AS stable_turns", "(id + i) % 4 = 0 AS fragile", "(id + i) % 20 / 100 AS segment_ratio")


@query(
    f"""WITH {_CAND} SELECT c.rec_id, c.k, o.k AS higher, CASE WHEN (c.selected_score IS NULL OR o.selected_score IS NULL) AND o.recommended_score IS NULL THEN false
      ELSE round(coalesce(c.selected_score, o.recommended_score) - coalesce(o.selected_score, o.recommended_score), 9) >= 0.03 END AS penalised FROM cand c JOIN cand o ON c.rec_id = o.rec_id AND o.k > c.k"""
)
def dz_guard_model_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.model_penalties(_candidates(spark, sf_dir))


@query(
    f"""WITH {_CAND} SELECT c.rec_id, c.k, arg_max(o.k, (o.score, -o.k)) AS refined FROM cand c JOIN cand o ON c.rec_id = o.rec_id AND o.formed = c.formed + 1 AND o.formed <= c.model_n AND o.weak + o.tiny <= c.weak + c.tiny AND o.stable >= o.formed
    WHERE c.model_n > c.formed AND c.confidence >= 0.4 AND c.severe > 0 GROUP BY 1, 2"""
)
def dz_guard_under_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.under_count(_candidates(spark, sf_dir))


@query(
    f"""WITH {_CAND}, p AS (SELECT c.rec_id, c.k, c.model_n AS m, o.k AS ok, o.formed AS f, o.score AS s FROM cand c JOIN cand o ON c.rec_id = o.rec_id AND o.formed > c.formed AND o.formed <= CASE WHEN c.model_n <= 2 THEN least(c.formed + 2, 4) ELSE least(c.formed + 2, 8) END AND o.weak = 0 AND o.tiny = 0)
    SELECT rec_id, k, CASE WHEN m <= 2 THEN arg_max(ok, (f, s, -ok)) ELSE arg_max(ok, (-f, s, -ok)) END AS refined FROM p GROUP BY rec_id, k, m"""
)
def dz_guard_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.conflict(_candidates(spark, sf_dir), "o.weak = 0 AND o.tiny = 0")


_YES = """said AS (SELECT m.rec_id, m.model_n FROM (SELECT DISTINCT rec_id, model_n FROM cand) m JOIN cand c ON m.rec_id = c.rec_id AND c.k >= greatest(2, m.model_n) GROUP BY 1, 2 HAVING count(*) FILTER (c.model_n = m.model_n) >= greatest(2, floor(0.6 * count(*))))"""


@query(
    f"""WITH {_CAND}, {_SUM}, {_YES}, h AS (SELECT rec_id, k, count(*) AS n, bool_and(segments >= 3 AND duration_s >= 15 AND stable_turns >= 0) AS ok FROM summ WHERE segments >= 0 GROUP BY 1, 2), g AS (SELECT rec_id, k, count(*) AS n, bool_and(segments >= 5 AND duration_s >= 20 AND stable_turns >= 1) AS ok FROM summ GROUP BY 1, 2)
    SELECT c.rec_id, c.k FROM cand c JOIN said s ON c.rec_id = s.rec_id AND c.model_n = s.model_n JOIN g ON c.rec_id = g.rec_id AND c.k = g.k
    WHERE c.model_n >= 5 AND formed = c.model_n AND confidence >= 0.4 AND tiny = 0 AND fragmented = 0 AND marginal = 0 AND g.n = c.model_n AND g.ok"""
)
def dz_guard_high_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.trusted_high(_candidates(spark, sf_dir), _speakers(spark, sf_dir))


@query(
    f"""WITH {_CAND}, {_YES} SELECT c.rec_id, c.k, arg_max(o.k, ((o.k = c.formed - 1)::INT, o.score, -o.k)) AS fallback FROM cand c JOIN said s ON c.rec_id = s.rec_id AND c.model_n = s.model_n
    JOIN cand o ON o.rec_id = c.rec_id AND o.formed = c.formed - 1 AND o.tiny + o.weak + o.fragmented + o.marginal = 0 AND o.stable >= c.formed - 1 AND o.recommended_score > 0 AND round(o.selected_score / o.recommended_score, 9) >= 0.45
    WHERE c.model_n IN (3, 4) AND c.formed = c.model_n AND c.confidence >= 0.4 AND c.confidence < 0.7 AND c.severe >= greatest(1, (c.formed + 1) // 2) GROUP BY 1, 2"""
)
def dz_guard_medium_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.medium_fallback(_candidates(spark, sf_dir))


@query(
    f"""WITH {_CAND}, {_SUM}, t AS (SELECT rec_id, k FROM summ GROUP BY 1, 2 HAVING bool_or(fragile AND (turns <= 1 OR stable_turns <= 1 OR segment_ratio < 0.035 OR duration_s < 45)) AND bool_or(NOT fragile AND turns <= 3 AND stable_turns <= 3 AND duration_s < 90))
    SELECT c.rec_id, c.k, o.k AS higher FROM cand c JOIN cand o ON c.rec_id = o.rec_id AND c.formed >= 3 AND o.formed >= 5 AND o.formed = c.formed + 1 AND o.tiny + o.weak + o.fragmented + o.marginal > 0 AND c.stable >= o.stable - 1 AND NOT (o.severe = 0) JOIN t ON t.rec_id = o.rec_id AND t.k = o.k"""
)
def dz_guard_weak_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.weak_tail(_candidates(spark, sf_dir), _speakers(spark, sf_dir), "o.severe = 0")
