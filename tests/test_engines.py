"""Rounding against Python's, the mapping between engines, assignments and windows on small cases."""

from __future__ import annotations

import math
import random

from cadenza.functions.numbers import exact_round
from cadenza.operators import engines


def test_exact_round(spark):
    pick = random.Random(3)
    values = [2.675, 0.125, 0.375, -0.125, 1.005, 0.5, 1.5, -2.5, 0.0, -0.001, 1e15 + 0.3, 1e300, float("nan"), None]
    values += [pick.uniform(-1000, 1000) for _ in range(500)] + [(k + 0.5) / 1000 for k in range(-500, 500)] + [k / 8 for k in range(-100, 100)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for r in rows.select("v", *(exact_round("v", d).alias(f"r{d}") for d in range(5))).collect():
        for d in range(5):
            got = r[f"r{d}"]
            assert (r.v is None and got is None) or (r.v is not None and math.isnan(r.v) and math.isnan(got)) or got == round(r.v, d), (r.v, d, got)


def test_engine_mapping(spark):
    pairs = [("a", "x"), ("b", "x"), ("b", "x"), ("a", "y"), ("c", "x"), ("b", "y"), ("a", "x"), ("", "x"), (None, "y")]
    left = spark.createDataFrame([(1, i, a) for i, (a, _) in enumerate(pairs)], "rec_id long, seg_idx int, speaker string")
    right = spark.createDataFrame([(1, i, b) for i, (_, b) in enumerate(pairs)], "rec_id long, seg_idx int, speaker string")
    got = {r.seg_idx: r.mapped for r in engines.cross_engine(left, right).collect()}
    assert got == {1: "y", 2: "y", 3: "x", 4: None}  # a takes x, b is left with y, c with none
    assert engines.cross_engine(left, right.where("seg_idx > 0")).count() == 0


def test_profile_assignment(spark):
    rows = [(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "x", 0.85), (1, "b", "y", 0.1), (1, "c", "z", 0.2)]
    got = engines.profile_assignment(spark.createDataFrame(rows, "rec_id long, speaker string, profile string, score double"), 0.3)
    assert {(r.speaker, r.profile) for r in got.collect()} == {("a", "y"), ("b", "x")}


def test_window_bounds(spark):
    raw = ['{"start": 1, "end": 2.5}', '[1, "2", "why"]', "[1]", "[2, 1]", "[1, 1]", '{"start": null, "end": 1}', "", "text", "{", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = {r.i: tuple(r.x) for r in rows.select("i", engines.window_bounds("raw").alias("x")).collect() if r.x}
    assert got == {0: (1.0, 2.5, "unknown"), 1: (1.0, 2.0, "why")}
