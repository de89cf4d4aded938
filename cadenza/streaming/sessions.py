"""Streaming counterparts: windows by event time, sessions and a stateful speaker-run detector."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, size: str = "10 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events and values by window and type; rows later than the watermark are dropped."""
    at = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions of events that are never further apart than the gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _runs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    speaker, n = state.get if state.exists else ("", 0)
    out = []
    for pdf in batches:
        for r in pdf.sort_values(["ts", "event_id"]).itertuples():
            if r.event_type == speaker:
                n += 1
            else:
                if n:
                    out.append((key[0], speaker, n))
                speaker, n = r.event_type, 1
    state.update((speaker, n))
    yield pd.DataFrame(out, columns=["user_id", "speaker", "rows"])


def streamed_runs(events: DataFrame) -> DataFrame:
    """Runs of one type per user, emitted when they end; the open run is state."""
    rows = events.select("user_id", "ts", "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(_runs, "user_id long, speaker string, rows long", "speaker string, n long", "append", GroupStateTimeout.NoTimeout)
