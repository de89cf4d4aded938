"""Registered queries: a name, a function of (spark, sf_dir), and SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.sources.adapters import SEGMENTS_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *, timeline: bool = True) -> Callable[[Query], Query]:
    """Register a query under its function's name; the SQL may use segments, ranges and turns."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            if timeline:
                again = "RECURSIVE " if text.startswith("WITH RECURSIVE ") else ""
                text = f"WITH {again}{SEGMENTS_SQL}" + (f", {text[5 + len(again) :]}" if text.startswith("WITH ") else f" {text}")
            ORACLES[f.__name__] = text
        return f

    return add
