"""Queries over text and time expressions, filters and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.operators import layers
from cadenza.operators import runs as rn
from cadenza.plans.registry import query
from cadenza.sources import writers
from cadenza.sources.adapters import ranges, segments, table, turns


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _clock(s: str, sep: str = ".") -> str:
    ms = f"CAST(round_even({s} * 1000, 0) AS BIGINT)"
    return f"lpad(CAST({ms} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 1000 % 60 AS VARCHAR), 2, '0') || '{sep}' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"


@query(f"""SELECT rec_id, seg_idx, {_clock('start')} AS dotted, {_clock('"end"', ',')} AS comma FROM segments""")
def tm_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("rec_id", "seg_idx", tx.clock("start").alias("dotted"), tx.clock("end", True).alias("comma"))


@query("SELECT rec_id, seg_idx, round(start, 3) AS seconds FROM segments")
def tm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("rec_id", "seg_idx", F.round(tx.parse_clock(tx.clock("start")), 3).alias("seconds"))


@query("SELECT event_id, CASE WHEN event_id * 7 > 10000 THEN event_id * 7 / 1000 ELSE event_id * 7 END AS seconds FROM events", timeline=False)
def tm_auto_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.auto_seconds((F.col("event_id") * 7).cast("double")).alias("seconds"))


@query("SELECT event_id, strftime(DATE '1970-01-01' + CAST(event_id % 30000 AS INTEGER), '%Y-%m-%d') AS day FROM events", timeline=False)
def tm_days_to_ymd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr("date_format(date_add(DATE'1970-01-01', CAST(event_id % 30000 AS INT)), 'yyyy-MM-dd')").alias("day"))


_CLEAN = "text"
for _p, _to in tx.CLEANUP:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_to.replace('$1', chr(92) + '1')}', 'g')"


@query(f"SELECT doc_id, md5(trim({_CLEAN}, ' ')) AS cleaned, greatest(0, length(text) - length({_CLEAN})) AS removed FROM documents", timeline=False)
def str_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, removed = tx.cleaned("text")
    return _docs(spark, sf_dir).select("doc_id", F.md5(text).alias("cleaned"), removed.cast("long").alias("removed"))


@query("SELECT doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) AS compacted, length(regexp_replace(text, '\\s+', '', 'g')) AS chars FROM documents", timeline=False)
def str_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.compact("text")
    return _docs(spark, sf_dir).select("doc_id", F.md5(t).alias("compacted"), F.length(t).cast("long").alias("chars"))


@query("SELECT doc_id, md5(regexp_replace(text, '[\\p{P}\\p{Z}\\s]', '', 'g')) AS form FROM documents", timeline=False)
def str_cer_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.scoring_form("text")).alias("form"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS tokens, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS types FROM documents", timeline=False)
def str_word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _docs(spark, sf_dir).select("doc_id", tx.word_tokens("text").alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("tokens"), F.size(F.array_distinct("w")).cast("long").alias("types"))


@query(
    """WITH t AS (SELECT item_id, text AS t FROM benchmark), g AS (SELECT item_id, unnest(list_transform(range(1, length(t)), lambda i: t[i:i + 1])) AS g FROM t
      UNION ALL SELECT item_id, unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2])) FROM t) SELECT item_id, g AS gram, count(*) AS n FROM g GROUP BY 1, 2""",
    timeline=False,
)
def str_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"))
    return b.select("item_id", F.explode(tx.ngrams("t", (2, 3))).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT event_id, repeat(left(event_type, 1 + CAST(event_id % 7 AS INT)), 1 + CAST(event_id % 5 AS INT)) || CASE WHEN event_id % 4 = 0 THEN 'x' ELSE '' END AS t FROM events)
    SELECT event_id, len(list_filter(range(1, 13), lambda k: length(t) % k = 0 AND length(t) // k >= 3 AND repeat(left(t, k), length(t) // k) = t)) > 0 AS repeated FROM t""",
    timeline=False,
)
def str_repeated_hallucination(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat(repeat(left(event_type, 1 + CAST(event_id % 7 AS INT)), 1 + CAST(event_id % 5 AS INT)), CASE WHEN event_id % 4 = 0 THEN 'x' ELSE '' END)")
    return table(spark, sf_dir, "events").select("event_id", tx.repeated_unit(text).alias("repeated"))


@query(
    """WITH n AS (SELECT rec_id, seg_idx, text, lead(text) OVER (PARTITION BY rec_id ORDER BY seg_idx) AS q FROM segments), k AS (SELECT rec_id, seg_idx, text, q, unnest(range(1, 13)) AS k FROM n WHERE q IS NOT NULL)
    SELECT rec_id, seg_idx, coalesce(max(k) FILTER (k <= length(text) AND k <= length(q) AND right(text, k) = left(q, k)), 0) AS overlap FROM k GROUP BY 1, 2"""
)
def str_suffix_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = segments(spark, sf_dir).withColumn("q", F.lead("text").over(rn.order())).where("q IS NOT NULL")
    return n.select("rec_id", "seg_idx", tx.suffix_prefix("text", "q", 12).cast("long").alias("overlap"))


@query(
    """SELECT rec_id, seg_idx, round(CAST(1 AS DOUBLE) * greatest(1, length(regexp_replace(text, '\\s+', '', 'g'))) + len(regexp_extract_all(text, '[，、,]')) * 1.2 + len(regexp_extract_all(text, '[。！？；：.!?;:]')) * 1.8, 6) AS weight FROM turns"""
)
def mt_cue_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("rec_id", "seg_idx", F.round(tx.cue_weight("text"), 6).alias("weight"))


@query("""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ')) AS text FROM pages""", timeline=False)
def str_strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.without_tags("html")).alias("text"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\b[A-Z]{2,6}\\b')) AS acronyms, len(regexp_extract_all(text, '\\d+(?:\\.\\d+)?\\s?(?:km|kg|cm|mm|m|g|%|s|h|元|米|公里|小时|分钟)')) AS measures FROM documents", timeline=False)
def str_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(tx.acronyms("text")).cast("long").alias("acronyms"), F.size(tx.measurements("text")).cast("long").alias("measures"))


@query(
    """SELECT page_id, left(regexp_replace(regexp_replace(url, '[^\\p{L}\\p{N}._-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 80) AS name FROM pages""",
    timeline=False,
)
def str_safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_name("url").alias("name"))


@query(
    """WITH t AS (SELECT rec_id, seg_idx, trim(text) AS t, start, "end" FROM segments) SELECT rec_id, seg_idx, length(replace(t, ' ', '')) >= 10 AND length(replace(t, ' ', '')) / greatest(0.001, "end" - start) > 12 AS dense FROM t"""
)
def flt_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("rec_id", "seg_idx", tx.dense("text", "start", "end").alias("dense"))


_REP = """t AS (SELECT doc_id, trim(text, ' ') AS t FROM documents), w AS (SELECT *, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS w, replace(t, ' ', '') AS c, length(t) AS n FROM t),
    r AS (SELECT *, len(w) >= 3 AND len(list_distinct(w)) / len(w) < 0.4 AS few, len(list_filter(range(1, 9), lambda k: n >= k * 3 AND trim(left(t, k)) <> '' AND (n - length(replace(t, left(t, k), ''))) // k * k >= n * 0.6 AND (n - length(replace(t, left(t, k), ''))) // k >= 3)) > 0 AS seeded,
      coalesce(list_max(list_transform(list_filter(list_distinct(string_split(c, '')), lambda x: x <> ''), lambda x: length(c) - length(replace(c, x, '')))) / nullif(length(c), 0) > 0.6, false) AS one FROM w)"""


@query(f"WITH {_REP} SELECT doc_id, n >= 6 AND (few OR seeded OR one) AS repetitive FROM r", timeline=False)
def flt_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.repetitive("text").alias("repetitive"))


@query("SELECT rec_id, seg_idx FROM segments WHERE NOT (CASE WHEN value = 0 THEN false ELSE value * -0.1 < -1.0 END)")
def flt_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where(~layers.low_logprob(F.col("value") * -0.1)).select("rec_id", "seg_idx")


@query("SELECT rec_id, seg_idx FROM segments WHERE contains(rtrim(trim(text), '，。！？,.!? '), 'error') OR contains(text, 'purchase 1')")
def flt_strong_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).where(layers.has_phrase("text", ("error", "purchase 1"))).select("rec_id", "seg_idx")


@query()
def flt_all_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumn("logprob", F.col("value") * -0.1)
    return layers.filtered(s, ranges(spark, sf_dir), "logprob", ("error",), ("嗯", "view 1"), 1.0).groupBy("rec_id", "reason").agg(F.count("*").alias("n"))


@query(
    """SELECT rec_id, seg_idx, array_to_string(CASE WHEN trim(text) = '' THEN ['empty'] ELSE list_filter([CASE WHEN "end" - start >= 8 THEN 'sparse' END], lambda r: r IS NOT NULL) END, ',') AS reasons FROM segments"""
)
def str_suspicion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("rec_id", "seg_idx", F.array_join(tx.suspicion("text", "start", "end"), ",").alias("reasons"))


@query(
    """WITH m AS (SELECT rec_id, count(*) AS segments, CAST(sum(length(regexp_replace(text, '\\s+', '', 'g'))) AS BIGINT) AS chars, round(count(*) FILTER (regexp_matches(text, '[，。！？；：、,.!?;:]')) / count(*), 4) AS punctuation_ratio FROM turns GROUP BY 1)
    SELECT *, CASE WHEN punctuation_ratio < 0.8 AND segments >= 5 THEN 'medium' ELSE 'low' END AS risk_level FROM m"""
)
def agg_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = turns(spark, sf_dir).groupBy("rec_id").agg(
        F.count("*").alias("segments"),
        F.sum(F.length(tx.compact("text"))).alias("chars"),
        F.round(F.count_if(F.col("text").rlike(tx.PUNCTUATION)) / F.count("*"), 4).alias("punctuation_ratio"),
    )
    return m.withColumn("risk_level", F.expr("CASE WHEN punctuation_ratio < 0.8 AND segments >= 5 THEN 'medium' ELSE 'low' END"))


@query("SELECT rec_id, sha256(string_agg(text, '\n' ORDER BY seg_idx)) AS sha256, CAST(count(*) AS BIGINT) AS rows FROM turns GROUP BY 1")
def ig_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.joined(turns(spark, sf_dir), "text", "\n", "all").select("rec_id", F.sha2("all", 256).alias("sha256"), "rows")


# Exports


@query(f"""SELECT rec_id, string_agg('[' || {_clock('start')} || ' - ' || {_clock('"end"')} || '] ' || trim(text), chr(10) ORDER BY seg_idx) || chr(10) AS content FROM segments WHERE trim(text) <> '' GROUP BY 1""")
def sink_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.txt(segments(spark, sf_dir))


@query(
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY seg_idx) AS k FROM segments WHERE trim(text) <> '')
    SELECT rec_id, string_agg(k || chr(10) || {_clock('start', ',')} || ' --> ' || {_clock('"end"', ',')} || chr(10) || trim(text) || chr(10), chr(10) ORDER BY seg_idx) AS content FROM n GROUP BY 1"""
)
def sink_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.srt(segments(spark, sf_dir))


@query(
    f"""WITH n AS (SELECT *, lag(speaker) OVER (PARTITION BY rec_id ORDER BY seg_idx) AS p, row_number() OVER (PARTITION BY rec_id ORDER BY seg_idx) AS k FROM segments)
    SELECT rec_id, string_agg(CASE WHEN k = 1 OR speaker IS DISTINCT FROM p THEN '## ' || coalesce(speaker, '?') || chr(10) ELSE '' END || '<a id="t-' || CAST(floor(start * 1000 + 1e-6) AS BIGINT) || '"></a>' || text, chr(10) ORDER BY seg_idx) AS content FROM n GROUP BY 1"""
)
def sink_md_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.markdown(segments(spark, sf_dir))


@query("SELECT rec_id, seg_idx, '{\"seg_idx\":' || seg_idx || ',\"text\":\"' || text || '\"' || CASE WHEN speaker IS NULL THEN '' ELSE ',\"speaker\":\"' || speaker || '\"' END || '}' AS json FROM segments")
def proj_segment_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("rec_id", "seg_idx", F.to_json(F.struct("seg_idx", "text", "speaker")).alias("json"))


@query("SELECT rec_id, count(*) FILTER (speaker IS DISTINCT FROM predicted) AS changed, count(*) AS rows FROM segments GROUP BY 1")
def agg_changed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).groupBy("rec_id").agg(F.count_if(F.expr("NOT (speaker <=> predicted)")).alias("changed"), F.count("*").alias("rows"))


@query(
    """WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '\\s+', '', 'g'), '([。！？.!?])', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents),
    p AS (SELECT doc_id, unnest(range(0, (len(s) - 1) // 4 + 1)) AS k, s FROM s) SELECT doc_id, k AS paragraph, md5(array_to_string(s[k * 4 + 1:k * 4 + 4], '')) AS text FROM p""",
    timeline=False,
)
def sink_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(tx.paragraphs("text")).alias("paragraph", "t"))
    return d.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.md5("t").alias("text"))


_TERMS = {"on": "ON", "the": "THE", "there": "THERE", "a.b": "A.B"}


@query(
    """WITH m AS (SELECT doc_id, regexp_extract_all(text, 'there|the|a\\.b|on') AS m, regexp_split_to_array(text, 'there|the|a\\.b|on') AS s FROM documents)
    SELECT doc_id, CAST(len(m) AS BIGINT) AS hits, md5(array_to_string(list_transform(range(1, len(s) + 1), lambda i: s[i] || CASE WHEN i <= len(m) THEN upper(m[i]) ELSE '' END), '')) AS text FROM m""",
    timeline=False,
)
def str_replace_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, text = tx.replaced_terms("text", _TERMS)
    return _docs(spark, sf_dir).select("doc_id", hits.cast("long").alias("hits"), F.md5(text).alias("text"))


@query("SELECT rec_id, seg_idx, regexp_replace(upper(speaker), '^(SPEAKER|SPK)[_ -]?', '') AS label FROM segments WHERE speaker IS NOT NULL")
def str_label_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat(F.lit("SPEAKER_"), F.upper("speaker"))
    return segments(spark, sf_dir).where("speaker IS NOT NULL").select("rec_id", "seg_idx", F.regexp_replace(named, "^(SPEAKER|SPK)[_ -]?", "").alias("label"))


_SAID = "concat(repeat('对', CAST(seg_idx % 9 AS INT)), CASE WHEN seg_idx % 4 = 0 THEN text WHEN seg_idx % 4 = 1 THEN '。' WHEN seg_idx % 4 = 2 THEN '？' ELSE ' ' END)"


@query(
    f"""WITH t AS (SELECT rec_id, seg_idx, {_SAID} AS t FROM segments)
    SELECT rec_id, seg_idx, CASE WHEN len(regexp_extract_all(t, '[一-鿿]')) >= 6 AND NOT regexp_matches(rtrim(t), '[。！？!?…]$') THEN rtrim(t) || '。' ELSE t END AS text FROM t"""
)
def str_terminal_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of up to eight ideographs, with and without an end mark, with blanks, Latin letters or more ideographs behind."""
    return segments(spark, sf_dir).select("rec_id", "seg_idx", tx.with_end_mark(F.expr(_SAID)).alias("text"))
