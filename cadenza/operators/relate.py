"""Further relations between segments, cues, labels, windows and runs of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.numbers import between, scaled_round
from cadenza.operators.intervals import merged, overlap_join


def attach(source: DataFrame, labels: DataFrame, columns: dict[str, int | None]) -> DataFrame:
    """Source rows with the labels' columns by position, doubles rounded; the source's own columns stay as they are."""
    add = labels.select("rec_id", "seg_idx", *(F.bround(c, d).alias(c) if d is not None else F.col(c) for c, d in columns.items()))
    return source.drop(*columns).join(add, ["rec_id", "seg_idx"], "left")


def timelines(segments: DataFrame, turns: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Turns clipped to each segment, neighbours of one speaker joined: (rec_id, seg_idx, speaker, start, end)."""
    keyed = segments.select("rec_id", "seg_idx", "start", "end")
    pairs = overlap_join(keyed, turns.select("rec_id", "start", "end", "speaker"))
    clip = pairs.select(F.struct("rec_id", "seg_idx", F.col("r_speaker").alias("speaker")).alias("rec_id"), F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))
    return merged(clip, tolerance).select("rec_id.rec_id", "rec_id.seg_idx", "rec_id.speaker", "start", "end")


def window_votes(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """Seconds of each speaker within a segment, as the union of their clipped turns."""
    t = timelines(segments, turns, 0.0)
    return t.groupBy("rec_id", "seg_idx", "speaker").agg(F.round(F.sum(F.col("end") - F.col("start")), 6).alias("seconds"))


def sliced_text(windows: DataFrame, segments: DataFrame) -> DataFrame:
    """Text of each window: whole rows where covered, a slice by time where not, in order."""
    pairs = overlap_join(windows.select("rec_id", "win", "start", "end"), segments.select("rec_id", "start", "end", "seg_idx", "text"))
    n, dur = F.length("r_text"), F.col("r_end") - F.col("r_start")
    a = F.floor(F.round(F.greatest(F.lit(0.0), F.col("start") - F.col("r_start")) / dur * n, 6))
    b = F.ceil(F.round(F.least(F.lit(1.0), (F.col("end") - F.col("r_start")) / dur) * n, 6))
    part = F.substring(F.col("r_text"), (a + 1).cast("int"), (b - a).cast("int"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("r_seg_idx", part.alias("t")))), lambda x: x["t"])
    return pairs.groupBy("rec_id", "win").agg(F.array_join(text, "").alias("text"))


def active_cue(times: DataFrame, cues: DataFrame, hold: float = 0.18, epsilon: float = 0.03) -> DataFrame:
    """The first cue (rec_id, cue_idx, start, end, reliable) active at each time; it holds until the next begins."""
    nxt = F.lead("start").over(W.partitionBy("rec_id").orderBy("cue_idx"))
    live = cues.withColumn("end", F.least(F.col("end") + hold, F.coalesce(nxt, F.col("end") + hold))).withColumn("start", F.col("start") - epsilon).where("reliable AND end >= start")
    probe = times.select("rec_id", "t", F.col("t").alias("start"), F.col("t").alias("end"))
    hit = overlap_join(probe, live.select("rec_id", "start", "end", "cue_idx"), closed=True).groupBy("rec_id", "t").agg(F.min("r_cue_idx").alias("cue_idx"))
    return times.select("rec_id", "t").join(hit, ["rec_id", "t"], "left")


def without_history(items: DataFrame, history: DataFrame, key: str, digest: str, seed: str, limit: int) -> DataFrame:
    """One item per content, none that was used before by key or content, in an order given by the seed."""
    newest = items.groupBy(digest).agg(F.max(key).alias(key))
    fresh = newest.join(history.select(key), key, "left_anti").join(history.select(digest), digest, "left_anti")
    return fresh.withColumn("selection", F.sha2(F.concat_ws(":", F.lit(seed), digest), 256)).orderBy("selection").limit(limit)


def sliding_best(segments: DataFrame, size: float, step: float, least: float) -> DataFrame:
    """Per recording the window with most speakers of enough seconds, then the largest least share, then the earliest."""
    span = segments.groupBy("rec_id").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    n = F.greatest(F.lit(0), F.floor((F.col("b") - F.col("a") - size) / step)).cast("int")
    wins = span.select("rec_id", F.posexplode(F.transform(F.sequence(F.lit(0), n), lambda i: F.round(F.col("a") + i * step, 6))).alias("win", "start"))
    wins = wins.withColumn("end", F.col("start") + size)
    pairs = overlap_join(wins, segments.where("speaker IS NOT NULL").select("rec_id", "start", "end", "speaker"))
    per = pairs.groupBy("rec_id", "win", "start", "r_speaker").agg(F.round(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")), 6).alias("s"))
    score = per.groupBy("rec_id", "win", "start").agg(F.count_if(F.col("s") >= least).alias("voices"), F.min("s").alias("least"), F.round(F.sum("s"), 6).alias("speech"))
    best = F.max(F.struct("voices", "least", "speech", (-F.col("win")).alias("w")))
    return score.groupBy("rec_id").agg(best.alias("m")).select("rec_id", (-F.col("m.w")).alias("win"), "m.voices", "m.least", "m.speech")


def weighted_average(chunks: DataFrame) -> DataFrame:
    """(rec_id, frame, score) of overlapping chunks' scores (rec_id, first, i, size, score), Hamming weights."""
    w = F.lit(0.54) - 0.46 * F.cos(2 * F.pi() * F.col("i") / F.greatest(F.lit(1), F.col("size") - 1))
    rows = chunks.select("rec_id", (F.col("first") + F.col("i")).alias("frame"), (w * F.col("score")).alias("x"), w.alias("w"))
    return rows.groupBy("rec_id", "frame").agg(F.round(F.sum("x") / F.sum("w"), 6).alias("score"))


def powerset_overlap(logits: str | Column, several: list[int]) -> Column:
    """Probability of the classes that stand for several speakers, by softmax."""
    c = F.col(logits) if isinstance(logits, str) else logits
    top = F.array_max(c)
    e = F.transform(c, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return sum((F.element_at(e, i + 1) for i in several), F.lit(0.0)) / total


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, one column for each share): continuous quantiles of the values that aren't null, by rank; no group is held in memory."""
    ranks = rows.where(F.col(value).isNotNull()).select(by, value, (F.row_number().over(W.partitionBy(by).orderBy(value)) - 1).alias("_r"), F.count("*").over(W.partitionBy(by)).alias("_n"))
    place = {name: (F.col("_n") - 1) * F.lit(q) for name, q in shares.items()}
    near = [F.max(F.when(F.col("_r") == side(p), F.col(value))).alias(f"_{name}_{side.__name__}") for name, p in place.items() for side in (F.floor, F.ceil)]
    at = ranks.groupBy(by).agg(F.max("_n").alias("_n"), *near)
    return at.select(by, *(between(F.col(f"_{name}_floor"), F.col(f"_{name}_ceil"), p - F.floor(p)).alias(name) for name, p in place.items()))


def signal_quality(frames: DataFrame) -> DataFrame:
    """(rec_id, noise, level, snr, silence) of frame levels (rec_id, rms), by exact percentiles; a frame without a level isn't silent."""
    at = quantiles(frames, "rec_id", "rms", {"noise": 0.15, "level": 0.85})
    quiet = F.coalesce(F.col("rms") <= F.col("noise") * 1.2, F.lit(False)).cast("double")
    rows = frames.where("rec_id IS NOT NULL").join(at, "rec_id", "left").groupBy("rec_id", "noise", "level").agg(F.avg(quiet).alias("silence"))
    snr = 20 * F.log10(F.greatest("level", F.lit(1e-9)) / F.greatest("noise", F.lit(1e-9)))
    return rows.select("rec_id", *(scaled_round(x, 6).alias(name) for name, x in (("noise", "noise"), ("level", "level"), ("snr", snr), ("silence", "silence"))))


def audio_channels(frames: DataFrame) -> DataFrame:
    """Correlation and loudness of two channels (rec_id, x, y)."""
    rms = lambda c: F.round(F.sqrt(F.avg(F.col(c) * F.col(c))), 6)
    return frames.groupBy("rec_id").agg(F.round(F.corr("x", "y"), 6).alias("correlation"), rms("x").alias("x_rms"), rms("y").alias("y_rms"))


def review_schema(items: DataFrame, statuses: list[str]) -> DataFrame:
    """Broken rules of review items (rec_id, id, start, end, status): repeated ids, bad times, unknown status."""
    rows = items.withColumn("_n", F.count("*").over(W.partitionBy("rec_id", "id")))
    rules = {"duplicate_id": F.col("_n") > 1, "bad_time": ~F.coalesce(F.expr("start >= 0 AND end > start"), F.lit(False)), "bad_status": ~F.coalesce(F.col("status").isin(statuses), F.lit(False))}
    codes = F.filter(F.array(*(F.when(c, k) for k, c in rules.items())), lambda x: x.isNotNull())
    return rows.select("rec_id", "id", F.explode(codes).alias("code"))


def parsed_srt(files: DataFrame) -> DataFrame:
    """(rec_id, number, start, end, text) of subtitle files (rec_id, content)."""
    from cadenza.functions.text import parse_clock

    blocks = files.select("rec_id", F.explode(F.split("content", "\n\n+")).alias("b")).where("trim(b) <> ''")
    lines = blocks.select("rec_id", F.split(F.trim("b"), "\n").alias("l"))
    times = F.split(F.col("l")[1], " --> ")
    return lines.select("rec_id", F.col("l")[0].cast("int").alias("number"), parse_clock(times[0]).alias("start"), parse_clock(times[1]).alias("end"), F.array_join(F.slice("l", 3, 1000), "\n").alias("text"))
