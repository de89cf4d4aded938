"""Small rules over segments, cues, reasons and texts: expressions and single joins, all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.functions import udfs
from cadenza.operators.intervals import merged, overlap_join

#: Review reasons that are noise, by how they begin, and those that are signals, by what they hold.
NOISY = (
    "推荐置信度不足",
    "段内短声纹窗存在换人切点",
    "段内短声纹窗显示多个说话人：当前单一说话人标签需抽听确认",
    "段内短声纹窗显示多个说话人，但不满足安全切分条件",
    "段内短声纹窗疑似换人，但证据重叠/接近",
    "段内短声纹窗疑似换人，但一侧时长过短",
)
SIGNALS = (
    "局部快速轮换风险",
    "局部夹心跳变",
    "短插话/边界跳变",
    "声线复核",
    "声线混合风险",
    "段内短声纹窗多次换人",
    "长段内检测到强新发言",
    "强新发言开场",
)
#: What joins reasons, the mark of a segment without speech, words before which a pause is likely.
SEPARATOR = "；"
NO_SPEECH = "（非语音）"
PAUSE_WORDS = "但是 所以 因为 然后 并且 其实 如果 大家 就是 那么 对吧".split()
#: Least length of a cue that is embedded alone, greatest overlap of a voice sample, and its padding.
CUE_SECONDS, SAMPLE_OVERLAP, SAMPLE_PADDING = 1.5, 0.02, 0.08
#: Marks that labels and annotations are compared without.
ANNOTATION_MARKS = r"[\s，。！？、；：,.!?;:'\"“”‘’()（）\[\]【】]+"


def recovery_norm(text: str) -> Column:
    """Compatibility form in lower case, of which ideographs, Latin letters and digits are kept."""
    return F.regexp_replace(F.lower(udfs.nfkc(F.coalesce(F.col(text), F.lit("")))), rf"[^{tx.CJK[1:-1]}a-z0-9]", "")


def strong_reasons(reason: Column) -> Column:
    """Of a joined reason the parts that are signals and not noise."""
    parts = F.filter(F.transform(F.split(reason, SEPARATOR), lambda p: F.trim(p)), lambda p: p != "")

    def keep(p: Column) -> Column:
        noisy, signal = F.lit(False), F.lit(False)
        for x in NOISY:
            noisy = noisy | p.startswith(x)
        for x in SIGNALS:
            signal = signal | p.contains(x)
        return ~noisy & signal

    return F.array_join(F.filter(parts, keep), SEPARATOR)


def merged_reasons(reasons: Column) -> Column:
    """An array of reasons as one text; a reason that the text so far holds isn't added."""
    said = F.filter(F.transform(reasons, lambda r: F.trim(F.coalesce(r, F.lit("")))), lambda r: r != "")
    add = lambda a, r: F.when(a == "", r).when(F.contains(a, r), a).otherwise(F.concat(a, F.lit(SEPARATOR), r))
    return F.aggregate(said, F.lit("").cast("string"), add)


def embeddable(start: str, end: str) -> Column:
    """Whether a cue is long enough to be embedded alone."""
    return F.col(end) - F.col(start) >= CUE_SECONDS


def sample_risk(risk: Column, candidates: Column, ratio: Column) -> Column:
    """Whether a voice sample may hold another voice: flagged, with candidates, or overlapped."""
    return F.coalesce(risk, F.lit(False)) | (F.coalesce(candidates, F.lit(0)) > 0) | F.coalesce(~F.isnan(ratio) & (ratio > SAMPLE_OVERLAP), F.lit(False))


def spoken_units(text: str | Column) -> Column:
    """Ideographs and Latin words."""
    t = F.col(text) if isinstance(text, str) else text
    ideographs = F.regexp_count(t, F.lit(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"))
    return ideographs + F.regexp_count(t, F.lit(r"[A-Za-z0-9]+(?:[._+-][A-Za-z0-9]+)*"))


def plausible_timing(text: str, start: str, end: str) -> Column:
    """Whether so much can be said in the time: short replies always, else twelve units a second."""
    d, n = F.greatest(F.lit(0.0), F.col(end) - F.col(start)), spoken_units(text)
    return (n <= 2) | (d >= 0.65) | (n <= F.greatest(F.lit(2), F.ceil(F.round(d * 12, 9))))


def speech_support(rows: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """``rows`` (rec_id, key, start, end, ...) with ``heard``: seconds of the ranges' union in each."""
    per = overlap_join(rows.select("rec_id", key, "start", "end"), merged(ranges))
    per = per.groupBy("rec_id", key).agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("heard"))
    return rows.join(per, ["rec_id", key], "left").withColumn("heard", F.round(F.coalesce("heard", F.lit(0.0)), 9))


def unsupported_text(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Segments whose text is emptied, if it is punctuation alone, or replaced by a mark, if it is long, sparse and without speech.

    Recordings without any range are left as they are.
    """
    some = ranges.select("rec_id").distinct().withColumn("known", F.lit(True))
    rows = speech_support(segments, ranges, "seg_idx").join(some, "rec_id", "left")
    said = F.length(recovery_norm("text"))
    sparse = (F.round(F.col("end") - F.col("start"), 9) >= 8.0) & (said <= 6) & (F.col("heard") <= 0.12)
    text = F.when(F.col("known").isNull(), F.col("text")).when(said == 0, "").when(sparse, NO_SPEECH).otherwise(F.col("text"))
    return rows.withColumn("text", text).drop("heard", "known")


def unreliable_cues(cues: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cues (rec_id, cue_idx, start, end, text, reliable) whose time can't be trusted, with reasons; recordings without ranges have none."""
    rows = speech_support(cues, ranges, "cue_idx").join(ranges.select("rec_id").distinct(), "rec_id")
    d, n = F.round(F.greatest(F.lit(0.0), F.col("end") - F.col("start")), 9), F.length(recovery_norm("text"))
    silent = (d >= 0.5) & (F.col("heard") <= 0.08) & (F.col("heard") / d <= 0.08)
    fast = (d >= 0.05) & (n >= 4) & (n / d > 12.0)
    # Names of the reasons.
    named = F.array(F.when(F.col("reliable") == F.lit(False), "collapsed_or_overlapping_boundary"), F.when(silent, "no_vad_speech_support"), F.when(fast, "impossible_text_speed"))
    rows = rows.withColumn("reasons", F.array_join(named, ","))
    return rows.where("reasons <> ''").select("rec_id", "cue_idx", "reasons")


def annotation_norm(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.lower(F.regexp_replace(F.coalesce(t, F.lit("")), ANNOTATION_MARKS, ""))


def arena_norm(text: str) -> Column:
    """Compatibility form, lower case, without punctuation, separators and blanks."""
    return F.regexp_replace(F.lower(udfs.nfkc(F.coalesce(F.col(text), F.lit("")))), r"[\p{P}\p{Z}\s]+", "")


def public_norm(text: str) -> Column:
    """Letters and numbers in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}\p{N}]+", ""))


def text_stream(text: str) -> tuple[Column, Column]:
    """Ideographs, Latin letters and digits in lower case, and the place of each in the text."""
    chars = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    kept = F.filter(chars, lambda x: x["c"].rlike(r"^[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}A-Za-z0-9]$"))
    return F.lower(F.array_join(F.transform(kept, lambda x: x["c"]), "")), F.transform(kept, lambda x: x["i"])


def soft_commas(text: str) -> Column:
    """Commas before words that tend to follow a pause, in long texts with few marks; not within the first eight characters."""
    t = F.col(text)
    marks = F.regexp_count(t, F.lit(tx.PUNCTUATION))
    few = (F.regexp_count(t, F.lit(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]")) >= 28) & (marks < F.greatest(F.lit(2), F.floor(F.length(t) / 28)))
    out = t
    for w in PAUSE_WORDS:
        after = "(?<!的)" if w == "就是" else ""
        out = F.regexp_replace(out, rf"(?s)(?<![，。！？；：、,.!?;:\s])(?<=.{{8}}){after}{w}", f"，{w}")
    return F.when(few, out).otherwise(t)


#: What a line ends with that the next one, a fragment of a word, belongs to.
_OPEN = r"的[工事话]|这[件]|那个|这个|团契|同工"


def joined_lines(text: str | Column) -> Column:
    """Exported lines of which one or two characters were broken off, joined to the line before."""
    t = F.col(text) if isinstance(text, str) else text
    lines = F.split(t, "\n")
    stamp = r"^\[[^\]]+\]\s*"

    def add(out: Column, line: Column) -> Column:
        body = F.regexp_replace(line, stamp, "")
        short = line.rlike(stamp) & body.rlike(r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]") & (F.length(F.regexp_replace(body, "^[。！？!?，,；;：:、 ]+|[。！？!?，,；;：:、 ]+$", "")) <= 2)
        last = F.substring_index(out, "\n", -1)
        whole = F.concat(F.regexp_replace(F.regexp_replace(out, r"\s+$", ""), "[。！？!?]+$", ""), F.trim(body))
        return F.when(short & last.rlike(_OPEN), whole).otherwise(F.concat(out, F.lit("\n"), line))

    return F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), F.element_at(lines, 1), add)


def preflight_windows(recordings: DataFrame, clip: float, clips: int) -> DataFrame:
    """(rec_id, start, seconds): probes at fixed fractions of (rec_id, duration); those that begin in the same second count once."""
    # Fractions for two probes or fewer, and for more.
    anchors = (0.2, 0.72) if max(1, clips) <= 2 else (0.12, 0.5, 0.82)
    d = F.col("duration")
    starts = F.array(*(F.least(F.greatest(d * a - clip / 2, F.lit(0.0)), F.greatest(d - clip, F.lit(0.0))) for a in anchors[: max(1, clips)]))
    starts = F.when((d <= 0) | (d <= clip), F.array(F.lit(0.0))).otherwise(starts)
    rows = recordings.select("rec_id", "duration", F.posexplode(starts).alias("i", "start")).withColumn("second", F.bround("start"))
    first = rows.groupBy("rec_id", "second").agg(F.min_by("start", "i").alias("start"), F.first("duration").alias("duration"))
    return first.select("rec_id", F.round("start", 6).alias("start"), F.round(F.when(F.col("duration") <= 0, clip).otherwise(F.least(F.lit(clip), F.col("duration") - F.col("start"))), 6).alias("seconds"))


def real_time_factor(seconds: Column, duration: Column) -> Column:
    """Seconds of work for each second of audio; 0 where there is none."""
    return F.when(duration > 0, seconds / duration).otherwise(0.0)


def profile_distance(pitch: Column, profile_pitch: Column, profile_confidence: Column) -> Column:
    """Distance of a pitch from a profile's; infinite where that is unknown or unsure."""
    sure = profile_pitch.isNotNull() & (F.coalesce(profile_confidence, F.lit(0.0)) >= 0.35)
    return F.when(sure, F.abs(pitch - profile_pitch)).otherwise(float("inf"))


def voice_lines(profiles: DataFrame, segments: DataFrame) -> DataFrame:
    """(rec_id, speaker, line): L1, H1, M1, U1 and so on by voice band (rec_id, speaker, voice_band), in order of first appearance."""
    said = segments.where("speaker IS NOT NULL AND speaker <> ''").groupBy("rec_id", "speaker").agg(F.min_by("start", "seg_idx").alias("at"))
    # Letters of the bands.
    letter = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in ("low", "L", "high", "H", "mid", "M"))), F.col("voice_band")), F.lit("U"))
    rows = profiles.withColumn("letter", letter).join(said, ["rec_id", "speaker"], "left")
    place = F.row_number().over(W.partitionBy("rec_id", "letter").orderBy(F.col("at").asc_nulls_last(), "speaker"))
    return rows.withColumn("line", F.concat("letter", place.cast("string"))).select("rec_id", "speaker", "line")


def sparse_labels(items: DataFrame, cues: DataFrame) -> DataFrame:
    """Label of each item (rec_id, seg_idx, item, start, end, speaker): the speaker of most of its cues' seconds, else the segment's own."""
    c = cues.select("rec_id", "seg_idx", F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.col("speaker").alias("c_speaker"))
    met = items.join(c, ["rec_id", "seg_idx"]).withColumn("x", F.least("end", "c_end") - F.greatest("start", "c_start")).where("x > 0 AND c_speaker <> ''")
    per = met.groupBy("rec_id", "seg_idx", "item", "c_speaker").agg(F.round(F.sum("x"), 9).alias("x"))
    best = per.groupBy("rec_id", "seg_idx", "item").agg(F.max(F.struct("x", "c_speaker")).alias("b"))
    rows = items.join(best, ["rec_id", "seg_idx", "item"], "left")
    return rows.select("rec_id", "seg_idx", "item", F.coalesce("b.c_speaker", "speaker").alias("label"), F.when(F.col("b").isNotNull(), "speaker_cue").otherwise("segment").alias("source"))


def cue_speakers(cues: DataFrame, speaker_cues: DataFrame) -> DataFrame:
    """(rec_id, seg_idx, cue_idx, speaker): the speaker cue of the cue's number, else the first that overlaps it enough."""
    s = speaker_cues.select("rec_id", "seg_idx", F.col("place"), F.col("cue_idx").alias("s_cue"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("speaker"))
    met = cues.select("rec_id", "seg_idx", "cue_idx", "start", "end").join(s, ["rec_id", "seg_idx"])
    same = F.coalesce(F.col("s_cue") == F.col("cue_idx"), F.lit(False))
    enough = F.round(F.least("end", "s_end") - F.greatest("start", "s_start"), 9) >= F.least(F.lit(0.25), F.greatest(F.lit(0.05), F.round((F.col("end") - F.col("start")) * 0.5, 9)))
    met = met.withColumn("prio", F.when(same, 0).when(enough, 1)).where("prio IS NOT NULL")
    best = met.groupBy("rec_id", "seg_idx", "cue_idx").agg(F.min(F.struct("prio", "place", "speaker")).alias("b"))
    return cues.select("rec_id", "seg_idx", "cue_idx").join(best, ["rec_id", "seg_idx", "cue_idx"], "left").select("rec_id", "seg_idx", "cue_idx", F.col("b.speaker").alias("speaker"))


def phrase_checks(checks: DataFrame, segments: DataFrame, before: int = 28, after: int = 72, plain: int = 80) -> DataFrame:
    """(rec_id, check, hit, snippet): whether a term of each check (rec_id, check, start, end, terms) is in the text of its time, and where.

    Times are closed ranges; a check without times is on the whole text.
    """
    s = segments.select("rec_id", "seg_idx", F.col("start").alias("s0"), F.col("end").alias("s1"), "text")
    met = checks.join(s, "rec_id").where("start IS NULL OR end IS NULL OR (s1 >= start AND s0 <= end)")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ")
    rows = met.groupBy("rec_id", "check").agg(F.first("terms").alias("terms"), text.alias("text"))
    rows = rows.withColumn("at", F.array_min(F.filter(F.transform("terms", lambda t: F.instr(F.col("text"), t)), lambda p: p > 0)))
    first = F.greatest(F.lit(0), F.col("at") - 1 - before)
    piece = F.substring("text", (first + 1).cast("int"), (F.col("at") - 1 + after - first).cast("int"))
    return rows.select("rec_id", "check", F.col("at").isNotNull().alias("hit"), F.when(F.col("at").isNull(), F.substring("text", 1, plain)).otherwise(piece).alias("snippet"))


def gold_text(item: Column) -> tuple[Column, Column]:
    """Text of a gold item (a map of strings) and the field it is from: correct_text if there, which then must not be blank, else the first filled one."""
    filled = lambda k: F.nullif(F.trim(F.try_element_at(item, F.lit(k))), F.lit(""))
    others = ("gold_text", "reference_text", "text", "transcript")
    fallback = F.coalesce(*(filled(k) for k in others))
    source = F.coalesce(*(F.when(filled(k).isNotNull(), k) for k in others))
    bad = F.raise_error(F.lit("a gold item has no text")).cast("string")
    given = F.map_contains_key(item, "correct_text")
    return F.when(given, F.coalesce(filled("correct_text"), bad)).otherwise(F.coalesce(fallback, bad)), F.when(given, "correct_text").otherwise(source)


def balanced(rows: DataFrame, seconds: float = 1.5, chars: int = 4) -> DataFrame:
    """Rows of a case that are long enough, in time and in letters, digits and ideographs."""
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}A-Za-z0-9]+", ""))
    return rows.where("case IS NOT NULL AND trim(case) <> ''").where(F.round(F.col("end") - F.col("start"), 9) >= seconds).where(n >= chars)


def mode_summary(rows: DataFrame) -> DataFrame:
    """One row per mode of (mode, status, risk_level, strong, review, terms, chars, rtf): sums over successful rows, errors counted."""
    # Ranks of risk levels.
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in ("low", 0, "medium", 1, "unknown", 2, "high", 3))), F.col("risk_level")), F.lit(2))
    ok = F.col("status") == "ok"
    of = lambda c: F.sum(F.when(ok, F.coalesce(c, F.lit(0))))
    g = rows.groupBy("mode").agg(
        F.count_if(ok).alias("ok_count"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("error_count"), F.max(F.when(ok, rank)).alias("risk"),
        of("strong").alias("strong"), of("review").alias("review"), of("terms").alias("terms"), of("chars").alias("chars"), F.round(F.avg(F.when(ok, F.coalesce("rtf", F.lit(0.0)))), 6).alias("avg_rtf"),
    )
    name = F.element_at(F.array(*map(F.lit, ("low", "medium", "unknown", "high"))), F.coalesce("risk", F.lit(2)) + 1)
    return g.select("mode", F.when(F.col("ok_count") > 0, "ok").otherwise("error").alias("status"), F.when(F.col("risk").isNotNull(), name).alias("risk_level"), "strong", "review", "terms", "chars", "avg_rtf", "ok_count", "error_count", F.when(F.col("chars") >= 10, 0).otherwise(1).alias("sparse"))
