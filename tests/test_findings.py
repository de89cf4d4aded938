"""Odd inputs and ties on which a query once differed from its SQL, or that were too much for it."""

from __future__ import annotations

import tracemalloc

import duckdb
import numpy as np
from oracle import assert_same, connection

from cadenza.operators import folds
from cadenza.operators import relate as rl
from cadenza.operators import vectors as vc
from cadenza.plans.catalog import ORACLES, QUERIES

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR"


def same_on(spark, folder, name: str, rows: str) -> None:
    """The query and its SQL on a table of events, given as a SELECT of event_id, ts, user_id, event_type and value."""
    with duckdb.connect() as con:
        con.execute(f"CREATE TABLE e ({EVENTS})")
        con.execute(f"INSERT INTO e BY NAME {rows}")
        con.execute(f"COPY e TO '{folder}/events.parquet' (FORMAT parquet)")
        con.execute(f"COPY (SELECT 1::BIGINT AS conv_id, 0 AS turn, 'user' AS role, 'a' AS text) TO '{folder}/conversations.parquet' (FORMAT parquet)")
    assert_same(QUERIES[name](spark, str(folder)).toPandas(), connection(str(folder)).execute(ORACLES[name]).df())


def test_quiet_frames_without_level(spark, tmp_path):
    same_on(
        spark,
        tmp_path,
        "agg_audio_quality",
        """SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, CASE WHEN i % 9 = 0 THEN NULL ELSE i % 5 END AS user_id, 'view' AS event_type, CASE WHEN i % 5 = 4 OR i % 7 = 0 THEN NULL ELSE i * 37 % 101 END AS value FROM range(200) t(i)""",
    )


def test_quantiles_to_the_last_bit(spark):
    with duckdb.connect() as con:
        rows = con.execute("SELECT i % 60 AS g, (hash(i) % 50000)::DOUBLE / 10000 AS x FROM range(6000) t(i) WHERE i % 60 > i // 100").fetchall()
        con.execute("CREATE TABLE t (g BIGINT, x DOUBLE)")
        con.executemany("INSERT INTO t VALUES (?, ?)", rows)
        want = con.execute("SELECT g, quantile_cont(x, 0.15) AS a, quantile_cont(x, 0.85) AS b FROM t GROUP BY 1").df()
    got = rl.quantiles(spark.createDataFrame(rows, "g long, x double"), "g", "x", {"a": 0.15, "b": 0.85})
    assert_same(got.toPandas(), want)


def test_error_rates_on_the_edge_of_rounding(spark, tmp_path):
    same_on(spark, tmp_path, "agg_der_jer", "SELECT event_id, ts, user_id, event_type, value FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id IN (128, 369)")


def test_equal_assignments():
    assert folds.best_assignment({("a", "x"): 2.0, ("a", "y"): 1.0, ("b", "x"): 1.0}) == {"a": "y", "b": "x"}
    # 0.1 + 0.2 and 0.3 are equal totals, whatever their last bits
    assert folds.best_assignment({("a", "x"): 0.3, ("b", "x"): 0.1, ("a", "y"): 0.2}) == {"a": "y", "b": "x"}
    ties = {("alt", "error"): 0.1 + 0.2, ("error", "error"): 0.3, ("click", "click"): 5.0}
    assert folds.best_assignment(ties) == folds.best_assignment(dict(reversed(ties.items()))) == {"alt": "error", "click": "click"}


def test_consistency_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(vc, "BLOCK", 200)
    r = np.random.default_rng(3)
    rows = [(i, i % 2, [float(x) for x in r.standard_normal(8)]) for i in range(1400)]
    odd = [(5000, 0, None), (5001, 0, [0.0] * 8), (5002, 0, [1.0, None]), (5003, 0, [2.0] * 3), (5004, None, [1.0] * 8), (4, 0, [1.0] * 8)]
    got = vc.consistency(spark.createDataFrame(rows + odd, "vec_id long, label int, e array<double>"), "label", "vec_id", "e").collect()
    for y, extra in ((0, [(4, [1.0] * 8)]), (1, [])):
        held = [(i, v) for i, k, v in rows if k == y] + extra
        x = np.array([v for _, v in held])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        i, j = np.triu_indices(len(x), 1)
        other = np.array([k for k, _ in held])[i] != np.array([k for k, _ in held])[j]
        s = np.round((x @ x.T)[i, j][other], 9)
        n = len(held) + (4 if y == 0 else 0)
        want = (y, n * (n - 1) // 2 - (y == 0), round(float(np.quantile(s, 0.5)), 6), round(float(np.quantile(s, 0.1)), 6), round(float(s.min()), 6))
        assert tuple(next(g for g in got if g.label == y)) == want


def test_eigenvalues_without_a_square_matrix(monkeypatch):
    r = np.random.default_rng(1)
    apart = np.vstack([r.standard_normal(16) * 6 + r.standard_normal((60, 16)) for _ in range(12)])
    for x in (r.standard_normal((700, 16)), apart, np.repeat(r.standard_normal((24, 16)), 30, axis=0)):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        whole = folds.least_eigenvalues(x, 14, 9)
        for kept in (1 << 24, 1000):
            with monkeypatch.context() as m:
                m.setattr(folds, "DENSE_ROWS", 100)
                m.setattr(folds, "STRETCH_CELLS", 1 << 16)
                m.setattr(folds, "KEPT_CELLS", kept)
                assert np.abs(folds.least_eigenvalues(x, 14, 9) - whole).max() < 1e-9


def test_eigengap_memory():
    x = np.random.default_rng(2).standard_normal((3000, 16))
    tracemalloc.start()
    folds.eigengap(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # a square matrix alone has 72 MB, and several were held
