"""Operators on literal rows: known values, brute force, and cases that must not happen."""

from __future__ import annotations

import itertools
import random

import pytest

from cadenza.functions.alignments import edit_ops, local_alignment
from cadenza.operators import folds, integrity, select
from cadenza.operators import intervals as iv
from cadenza.operators import joins as jn
from cadenza.operators import runs as rn
from cadenza.sources import readers
from pyspark.sql import functions as F

SEG = "rec_id string, seg_idx int, start double, end double, text string, speaker string"


def segs(spark, rows):
    return spark.createDataFrame([("r", i, *r) for i, r in enumerate(rows)], SEG)


def test_turns_join_over_small_gaps_only(spark):
    s = segs(spark, [(0.0, 2.0, "x", "A"), (3.0, 5.0, "x", "A"), (7.0, 8.0, "x", "A"), (8.0, 9.0, "嗯，对", "B"), (9.0, 9.5, "x", "A"), (9.6, 10.0, "x", None)])
    got = {r.speaker: r for r in rn.speaker_summary(s).collect()}
    assert (got["A"].segments, got["A"].turns, got["A"].stable_turns) == (4, 3, 1)
    assert (got["B"].sandwiched_segments, got["B"].filler_segments, got["B"].short_segments) == (1, 1, 1)
    assert got["A"].segment_ratio == round(4 / 6, 6)


def test_overlap_ratio_uses_the_union(spark):
    s = segs(spark, [(0.0, 2.0, "x", "A"), (2.0, 3.0, "x", "A")])
    o = spark.createDataFrame([("r", 0.5, 1.0), ("r", 0.8, 1.3)], "rec_id string, start double, end double")
    got = [(r.overlap_ratio, r.speaker_overlap_risk) for r in iv.overlap_ratio(s, o).orderBy("seg_idx").collect()]
    assert got == [(0.4, True), (0.0, False)]


def brute_union(pieces):
    return sum(any(s <= t < e for s, e in pieces) for t in range(0, 120))


def test_interval_algebra_against_points(spark):
    r = random.Random(5)
    a = [(x, x + r.randint(1, 9)) for x in (r.randint(0, 100) for _ in range(25))]
    b = [(x, x + r.randint(1, 9)) for x in (r.randint(0, 100) for _ in range(12))]
    df = lambda xs: spark.createDataFrame([("r", float(s), float(e)) for s, e in xs], "rec_id string, start double, end double")
    assert iv.union_duration(df(a)).first().seconds == brute_union(a)
    left = sum(any(s <= t < e for s, e in a) and not any(s <= t < e for s, e in b) for t in range(120))
    assert sum(x.end - x.start for x in iv.subtracted(df(a), df(b)).collect()) == left


def test_long_recordings_join_each_pair_once(spark):
    a = spark.createDataFrame([("r", 1, 10.0, 200.0)], "rec_id string, seg_idx int, start double, end double")
    b = spark.createDataFrame([("r", float(x), float(x) + 35) for x in range(0, 190, 7)], "rec_id string, start double, end double")
    assert iv.overlap_join(a, b).count() == sum(1 for x in range(0, 190, 7) if x < 200 and x + 35 > 10)


def der(spark, ref, pred):
    df = lambda xs: spark.createDataFrame([("u", float(s), float(e), w) for s, e, w in xs], "rec_id string, start double, end double, speaker string")
    active = iv.active_sets(df(ref), df(pred))
    p = iv.error_parts(active).first()
    w = {(r.pred, r.ref): r.seconds for r in iv.pair_seconds(active).collect()}
    m = folds.best_assignment(w)
    confusion = p.matchable_s - sum(w[x] for x in m.items())
    return p.miss_s, p.false_alarm_s, round(confusion, 6), round((p.miss_s + p.false_alarm_s + confusion) / p.reference_s, 6), m


def test_error_parts(spark):
    assert der(spark, [(0, 10, "A")], [(0, 7, "X"), (8, 10, "Y"), (10, 12, "Y")])[:4] == (1.0, 2.0, 2.0, 0.5)
    got = der(spark, [(0, 5, "张三"), (5, 10, "李四")], [(0, 5, "SPEAKER_B"), (5, 10, "SPEAKER_A")])
    assert got[3] == 0 and got[4] == {"SPEAKER_A": "李四", "SPEAKER_B": "张三"}


def test_assignment_is_global_and_optimal():
    assert folds.best_assignment({("X", "A"): 9, ("X", "B"): 8, ("Y", "A"): 7, ("Y", "B"): 0}) == {"X": "B", "Y": "A"}
    r = random.Random(3)
    for _ in range(60):
        n, m = r.randint(1, 5), r.randint(1, 5)
        w = {(f"a{i}", f"b{j}"): float(r.randint(0, 9)) for i in range(n) for j in range(m)}
        left, right = [f"a{i}" for i in range(n)], [f"b{j}" for j in range(m)]
        best = max(sum(w.get(p, 0) for p in zip(x, y, strict=False)) for x in itertools.permutations(left) for y in itertools.permutations(right))
        got = folds.best_assignment(w)
        assert len(set(got.values())) == len(got) and sum(w[p] for p in got.items()) == best


def test_hysteresis_joins_short_gaps(spark):
    score = [0.1] * 10 + [0.8] * 18 + [0.2] * 3 + [0.75] * 19
    f = spark.createDataFrame([("r", i, x) for i, x in enumerate(score)], "rec_id string, frame int, score double")
    got = iv.hysteresis(f, 0.55, 0.45, 0.02, 0.1, 0.1).collect()
    assert len(got) == 1 and abs(got[0].start - 0.2) < 1e-6 and abs(got[0].end - 1.0) < 1e-6


def test_alignments():
    assert edit_ops("kitten", "sitting") == (2, 0, 1)
    assert edit_ops("", "ab") == (0, 0, 2)
    assert local_alignment("bcd", "xxbcdyy") == (0, 2, 5)
    assert local_alignment("", "abc")[0] == 0


def test_nearest_turn_when_none_overlaps(spark):
    cues = segs(spark, [(5.0, 6.0, "x", None), (20.0, 21.0, "x", None)])
    turns = spark.createDataFrame([("r", 0.0, 2.0, "A"), ("r", 9.0, 10.0, "B")], "rec_id string, start double, end double, speaker string")
    assert [(r.seg_idx, r.speaker) for r in jn.overlap_argmax(cues, turns).orderBy("seg_idx").collect()] == [(0, "A"), (1, "B")]


def test_folds():
    rows = [{"seg_idx": i, "start": s, "end": e, "text": t, "speaker": "A", "value": v} for i, (s, e, t, v) in enumerate([(0, 8, "今天我们一起来看这本书", 1), (8.1, 8.6, "吧", 9), (9, 21, "x", 5), (30, 31, "y", 7)])]
    assert [w["rows"] for w in folds.span_windows(rows, 20, 1.5)] == [2, 1, 1]
    assert [r["text"] for r in folds.merge_fragments(rows, 1.2, 0.8, 8)][0].endswith("吧")
    assert [r["seg_idx"] for r in folds.spaced(rows, 3.0, 2)] == [1, 3]
    assert [c["rows"] for c in folds.chunk_texts(rows, 12)] == [2, 2]
    assert folds.speech_chunks([{"start": 0, "end": 12}], 5.0, 0.75) == [{"chunk": 0, "start": 0.0, "end": 5.0}, {"chunk": 1, "start": 5.0, "end": 10.0}, {"chunk": 2, "start": 10.0, "end": 12}]
    assert folds.best_permutation([("a", "x"), ("a", "x"), ("b", "y")]) == {"a": "x", "b": "y"}


def test_weak_phrases_need_company_or_silence(spark):
    from cadenza.operators import layers

    def dropped(*rows):
        df = spark.createDataFrame([(1, *r) for r in rows], "rec_id int, seg_idx int, start double, end double, text string")
        return [r.seg_idx for r in df.withColumn("gone", layers.weak_phrase(df, ("谢谢",), 5)).where("gone").orderBy("seg_idx").collect()]

    a, weak = (0, 0.0, 1.0, "a"), (1, 1.0, 2.0, "谢谢")
    assert dropped(a, weak, (2, 2.0, 3.0, "b")) == []
    assert dropped(a, weak, (2, 9.0, 10.0, "b")) == [1]
    assert dropped(a, weak, (2, 2.0, 3.0, "谢谢")) == [1, 2]


def test_annotations_reject_bad_times(spark):
    import pytest

    good = spark.createDataFrame([("k", '{"segments":[{"start":1,"duration":2,"speakers":["A","B"]}]}')], "key string, value string")
    assert sorted((r.start, r.end, r.speaker) for r in readers.annotations(good, "key").collect()) == [(1.0, 3.0, "A"), (1.0, 3.0, "B")]
    bad = spark.createDataFrame([("k", '{"segments":[{"start":3,"end":2,"speaker":"A"}]}')], "key string, value string")
    with pytest.raises(Exception, match="invalid time"):
        readers.annotations(bad, "key").collect()


def test_rttm_skips_comments(spark):
    t = spark.createDataFrame([("# c",), ("",), ("SPEAKER u 1 0.5 1.5 <NA> <NA> A <NA>",)], "value string")
    assert [tuple(r) for r in readers.rttm(t).collect()] == [("u", 0.5, 2.0, "A")]


def test_terms_keep_their_first_place(spark):
    t = spark.createDataFrame([(1, "# list\n- alpha, beta\nbeta;gamma # more\n" + "x" * 49)], "k int, value string")
    assert [(r.term, r.place) for r in readers.terms(t, "k").orderBy("place").collect()] == [("alpha", 1), ("beta", 2), ("gamma", 3)]


def test_violations(spark):
    s = segs(spark, [(0.0, 2.0, "x", "A"), (1.0, 0.5, " ", None)])
    assert sorted((r.seg_idx, r.code) for r in integrity.violations(s).collect()) == [(1, "empty"), (1, "end_falls"), (1, "no_speaker"), (1, "not_positive"), (1, "overlap")]


def test_quota_comes_before_the_fill(spark):
    d = spark.createDataFrame([("a", 9), ("a", 8), ("a", 7), ("b", 1)], "g string, v int")
    from pyspark.sql import functions as F

    assert sorted(tuple(r) for r in select.quota_then_fill(d, "g", [F.desc("v")], 1, 3).collect()) == [("a", 8), ("a", 9), ("b", 1)]


def test_streaming_sessions_and_runs(spark, tmp_path):
    import datetime as dt

    from cadenza.streaming import sessions

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=m), 1, k, 1.0) for i, (m, k) in enumerate([(0, "a"), (5, "a"), (9, "b"), (300, "b"), (301, "a")])]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("sess", sessions.sessions(source), "complete"), ("runs", sessions.streamed_runs(source), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.n for r in spark.table("sess").collect()) == [2, 3]
    assert [(r.speaker, r.rows) for r in spark.table("runs").collect()] == [("a", 2), ("b", 2)]


def test_hotword_candidates_are_ngrams(spark):
    """Pieces of words and across blanks, another first letter, lengths of one more or less; Chinese ones by default."""
    from cadenza.operators import terms

    rows = spark.createDataFrame([(1, "the xstat ions"), (2, "我们去华为元开会"), (3, None), (4, "stations")], "id int, text string")
    wanted = spark.createDataFrame([("stations",), ("华为云",), ("x",)], "term string")
    got = lambda **how: {(r.id, r.term, r.place): (r.word, r.score) for r in terms.hotword_candidates(rows, "id", wanted, **how).collect()}
    assert got() == {(2, "华为云", 1): ("华为", 0.8), (2, "华为云", 2): ("去华为", 0.667), (2, "华为云", 3): ("华为元", 0.667)}
    latin = got(letter="[a-z]")
    assert [latin[1, "stations", k] for k in (1, 2, 3)] == [("station", 0.933), ("tations", 0.933), ("xstation", 0.875)]
    assert [latin[4, "stations", k] for k in (1, 2)] == [("station", 0.933), ("tations", 0.933)]
    assert not any(t == "x" or i == 3 for i, t, _ in latin)


def test_like_triples_against_a_scan(spark):
    """Threes of like texts, found one after the other: what has gone no longer counts."""
    import random
    from difflib import SequenceMatcher

    from cadenza.operators import layers

    r = random.Random(8)
    rows = [(rec, i, r.choice(["good morning all", "good morning al", "other words here", ""]) if rec else "same again here") for rec in range(4) for i in range(40)]
    like = lambda a, b: bool(a and b) and SequenceMatcher(None, a, b).ratio() >= 0.9
    want = set()
    for rec in range(4):
        texts, free = [t for k, _, t in rows if k == rec], 0
        for i in range(len(texts) - 2):
            if i >= free and like(texts[i], texts[i + 1]) and like(texts[i + 1], texts[i + 2]):
                want |= {(rec, i + 1), (rec, i + 2)}
                free = i + 3
    got = layers.like_triples(spark.createDataFrame(rows, "rec_id int, seg_idx int, text string"))
    assert {(x.rec_id, x.seg_idx) for x in got.where("repeats").collect()} == want and len(want) > 30


def test_layers_in_turn(spark):
    from cadenza.operators import layers

    rows = [
        (0, 0.0, 1.0, "far from speech", -0.1),
        (1, 10.0, 11.0, "low", -3.0),
        (2, 12.0, 13.0, "ha ha ha ha ha ha", -0.1),
        (3, 14.0, 14.1, "many letters in no time at all", -0.1),
        (4, 15.0, 16.9, "please subscribe!", -0.1),
        (5, 17.0, 18.0, "thanks", -0.1),
        (6, 18.0, 19.0, "thanks", -0.1),
        (7, 19.0, 20.0, "good line", -0.1),
        (8, 20.0, 21.0, "good line", -0.1),
        (9, 21.0, 22.0, "good line.", -0.1),
        (10, 23.0, 24.0, "thanks", -0.1),
        (11, 25.0, 26.0, "the end", 0.0),
    ]
    s = spark.createDataFrame([(1, *x) for x in rows], "rec_id long, seg_idx int, start double, end double, text string, logprob double")
    heard = spark.createDataFrame([(1, 9.0, 30.0)], "rec_id long, start double, end double")
    got = {x.seg_idx: x.reason for x in layers.filtered(s, heard, "logprob", ("subscribe",), ("thanks",)).collect()}
    assert [got[i] for i in range(12)] == ["vad", "logprob", "repetition", "density", "phrase", "weak_phrase", "weak_phrase", "kept", "similar", "similar", "kept", "kept"]


def test_three_guards(spark):
    from cadenza.operators import review

    cols = "rec_id int, speaker string, duration_s double, segment_ratio double, turns int, short_ratio double, filler_ratio double, mergeable boolean"
    long = (100.0, 0.3, 9, 0.1, 0.1)
    rows = [(1, s, *long, s == "a") for s in "abcd"] + [(2, s, *long, s == "a") for s in "abc"] + [(3, s, *long, False) for s in "abcd"]
    rows += [(4, "a", 17.0, 0.3, 9, 0.1, 0.1, True), (4, "b", *long, False), (4, "c", *long, False), (5, "a", 17.0, 0.3, 9, 0.1, 0.1, True), (5, "b", *long, False)]
    rows += [(6, "a", 100.0, 0.3, 5, 0.55, 0.45, True), (6, "b", *long, False), (6, "c", *long, False)]
    got = {r.rec_id: r.merge for r in review.auto_merge(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}
    said = [(1, 2, 2), (1, 3, 2), (1, 4, 2), (1, 5, 3), (2, 2, 2), (2, 3, 3), (3, 2, 0), (3, 3, 0)]
    got = {(r.rec_id, r.model): r.consistent for r in review.consistent_recommendations(spark.createDataFrame(said, "rec_id int, k int, model int")).collect()}
    assert got == {(1, 2): True, (1, 3): False, (2, 2): False, (2, 3): False, (3, 0): False}
    seq = spark.createDataFrame([(["a", "a", "b"], ["a", "b", "b"]), (["a"], ["a", "b"]), (["a", "b", "a"], ["a", "b"]), (["b", "a"], ["a", "b"]), ([], [])], "c array<string>, g array<string>")
    assert [r[0] for r in seq.select(review.error_type(F.col("c"), F.col("g"))).collect()] == ["", review.MISSED, review.EXTRA, review.WRONG, ""]


def test_permutation_of_many_labels():
    pairs = [(f"p{i}", f"r{(i * 5) % 14}") for i in range(14) for _ in range(3)] + [("p1", "r0"), ("p2", "r0")]
    assert folds.best_permutation(pairs) == {f"p{i}": f"r{(i * 5) % 14}" for i in range(14)}


def test_soft_commas_against_re(spark):
    import re

    from cadenza.operators import rules

    r = random.Random(6)
    parts = ["我们今天一起来看", "但是", "的就是", "就是", "，然后", "大家", " 因为", "对吧", "abc", "这段话很长很长很长"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(120)]

    def plain(t: str) -> str:
        if len(re.findall("[\u3400-\u4dbf\u4e00-\u9fff]", t)) < 28 or len(re.findall("[，。！？；：、,.!?;:]", t)) >= max(2, len(t) // 28):
            return t
        for w in rules.PAUSE_WORDS:
            out, at = "", 0
            for i in (m.start() for m in re.finditer(w, t)):
                if i >= 8 and not re.match(r"[，。！？；：、,.!?;:\s]", t[i - 1]) and not (w == "就是" and t[i - 1] == "的"):
                    out, at = out + t[at:i] + "，", i
            t = out + t[at:]
        return t

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", rules.soft_commas("text").alias("t")).collect()
    assert {x.i: x.t for x in got} == {i: plain(t) for i, t in enumerate(texts)}
    assert sum(plain(t) != t for t in texts) > 10


def test_reasons_and_windows(spark):
    from cadenza.operators import rules

    one = spark.range(1)
    assert one.select(rules.merged_reasons(F.array(F.lit(" a"), F.lit(None), F.lit("ab"), F.lit("b"), F.lit("c")))).first()[0] == "a；ab；c"
    assert one.select(rules.strong_reasons(F.lit("推荐置信度不足：声线复核；x；声线复核； 强新发言开场"))).first()[0] == "声线复核；强新发言开场"
    d = spark.createDataFrame([(1, 0.0), (2, 40.0), (3, 61.0), (4, 1000.0)], "rec_id int, duration double")
    got = sorted((r.rec_id, r.start, r.seconds) for r in rules.preflight_windows(d, 60.0, 3).collect())
    assert got == [(1, 0.0, 60.0), (2, 0.0, 40.0), (3, 0.0, 60.0), (3, 1.0, 60.0), (4, 90.0, 60.0), (4, 470.0, 60.0), (4, 790.0, 60.0)]
    text = "[00:01] 他的工。\n[00:02] 作\nplain\n[00:03] 人"
    assert one.select(rules.joined_lines(F.lit(text))).first()[0] == "[00:01] 他的工作\nplain\n[00:03] 人"


def test_gold_templates(spark):
    df = spark.createDataFrame([(1, '[{"id": "1"}]'), (2, '\ufeff{"rows": [{"id": "2"}, {"id": "3"}], "source_json": "x"}'), (3, '{"x": 1}')], "k int, value string")
    got = readers.gold_rows(df.where("k < 3"), "k").collect()
    assert sorted((r.k, r.row_key, r.place, r["row"]["id"]) for r in got) == [(1, "list", 0, "1"), (2, "rows", 0, "2"), (2, "rows", 1, "3")]
    with pytest.raises(Exception, match="not a gold template"):
        readers.gold_rows(df, "k").collect()


def test_guard_fallbacks(spark):
    """Each guard's one condition at its bound."""
    from cadenza.operators import guards

    cols = "rec_id int, k int, formed int, stable int, weak int, tiny int, fragmented int, marginal int, severe int, score double, model_n int, confidence double, selected_score double, recommended_score double"
    clean = (0, 0, 0, 0)
    rows = [
        (1, 2, 2, 2, *clean, 0, 5.0, 3, 0.4, 0.45, 1.0), (1, 3, 3, 3, *clean, 2, 4.0, 3, 0.4, 0.5, 1.0), (1, 4, 4, 4, *clean, 0, 1.0, 3, 0.4, 0.48, 1.0),
        (2, 2, 2, 2, *clean, 0, 5.0, 3, 0.7, 0.44, 1.0), (2, 3, 3, 3, *clean, 2, 4.0, 3, 0.7, None, 1.0), (2, 4, 4, 3, *clean, 0, 1.0, 3, 0.7, 0.5, None),
    ]
    c = spark.createDataFrame(rows, cols)
    assert [(r.rec_id, r.k, r.fallback) for r in guards.medium_fallback(c).collect()] == [(1, 3, 2)]
    said = {(r.rec_id, r.k, r.higher): r.penalised for r in guards.model_penalties(c).collect()}
    assert said == {(1, 2, 3): False, (1, 2, 4): False, (1, 3, 4): False, (2, 2, 3): False, (2, 2, 4): False, (2, 3, 4): False}
    up = spark.createDataFrame([(1, 2, 2, 2, *clean, 1, 5.0, 4, 0.4, None, None), (1, 3, 3, 3, *clean, 0, 4.0, 4, 0.4, None, None), (1, 5, 3, 3, *clean, 0, 4.0, 4, 0.4, None, None)], cols)
    assert [(r.k, r.refined) for r in guards.under_count(up).collect()] == [(2, 3)]
    assert [(r.k, r.refined) for r in guards.conflict(up, "o.stable = o.formed").collect()] == [(2, 3)]
