"""Breaks of texts against a walk over their characters, and the rules around changes on small cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import breaks
from cadenza.operators import overlaps

TEXTS = ["", "a", "。", "。。。", "好。好的！\n真的？" * 9, "x" * 200, "，，，，，，，，，，，，，，", "ab,cd,ef,g", "😀" * 81 + "。", "abcdefghijkl.", "no mark at the end; or " * 5, None]


def walk(text, marks, least, most):
    found, last = [], 0
    for place, c in enumerate(text or "", 1):
        if (c in marks and place - last >= least) or place - last >= most:
            found.append(place)
            last = place
    return found if found and last == len(text) else [*found, len(text or "")]


def test_breaks(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    got = rows.select("i", breaks.sentence_breaks("text").alias("s"), breaks.cue_breaks("text").alias("c")).collect()
    for r in got:
        assert r.s == walk(TEXTS[r.i], breaks.SENTENCE_MARKS, 1, breaks.SENTENCE_CHARS), TEXTS[r.i]
        assert r.c == walk(TEXTS[r.i], breaks.CUE_MARKS, breaks.CUE_SPAN, breaks.CUE_CHARS), TEXTS[r.i]


def test_split_by_share(spark):
    cases = [("第一句话。第二句话在这里", 0.5, ("第一句话。", "第二句话在这里")), ("abcdefghij", 0.5, ("abcde", "fghij")), ("abcdefg", 0.5, None), ("", 0.5, None), (None, 0.5, None), ("abcd，efgh，ijkl", 0.5, ("abcd，", "efgh，ijkl"))]
    rows = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(cases)], "i int, text string, share double")
    got = {r.i: r for r in rows.select("i", breaks.split_by_share("text", "share").alias("x"), breaks.split_by_share("text", "share", at_mark=True).alias("m")).collect()}
    for i, (_, _, want) in enumerate(cases):
        assert (tuple(got[i].x) if got[i].x else None) == want
    assert got[1].m is None and tuple(got[0].m) == cases[0][2]


def test_near_changes(spark):
    cues = spark.createDataFrame([("r", i, float(2 * i), float(2 * i + (1.8 if i % 2 else 0.4))) for i in range(9)], "rec_id string, seg_idx int, start double, end double")
    found = lambda t: sorted(r.seg_idx for r in overlaps.near_changes(cues, spark.createDataFrame([("r", t)], "rec_id string, time double")).collect())
    assert found(6.5) == [2, 3, 4]  # held by cue 3; cue 5 begins too late
    assert found(-5.0) == [0, 1]
    assert found(99.0) == [7, 8]
    got = overlaps.near_changes(cues, spark.createDataFrame([("r", 6.5)], "rec_id string, time double"))
    assert {r.seg_idx: r.win_start for r in got.select("seg_idx", F.round("win_start", 3).alias("win_start")).collect()} == {2: None, 3: 6.15, 4: None}


def test_second_speakers_empty(spark):
    none = spark.createDataFrame([], "rec_id string, start double, end double, speaker string, confidence double")
    assert overlaps.second_speakers(none, none, none).count() == 0
