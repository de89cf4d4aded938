"""Compare a query with its SQL in DuckDB over the same files, whatever the order of rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v) -> str:
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or str(v) in ("<NA>", "NaT") or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return str(int(v)) if float(v).is_integer() else repr(float(v))
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return str(v)


def rows(frame, columns: list[str]) -> list[tuple]:
    return sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None))


def assert_same(got, want) -> None:
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = rows(got, columns), rows(want, columns)
    assert a == b, (sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3])
