"""The driver's tables as timed, speaker-labelled relations.

Times are offsets in seconds within a recording. Every relation has explicit keys
(rec_id, seg_idx), because rows of a DataFrame have no order of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as segments: a user is a recording, an event a segment; times follow from its place and id."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e = e.withColumn("seg_idx", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    begin = F.expr("seg_idx * 2000 + (event_id * 37) % 11 * 100")
    last = F.expr("300 + (event_id * 53) % 29 * 100")
    return e.select(
        F.col("user_id").alias("rec_id"),
        "seg_idx",
        "event_id",
        (begin / 1000).alias("start"),
        ((begin + last) / 1000).alias("end"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN '嗯，对' ELSE concat(event_type, ' ', event_id % 50) END").alias("text"),
        F.expr("CASE WHEN event_id % 23 <> 0 THEN event_type END").alias("speaker"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN 'alt' ELSE event_type END").alias("predicted"),
        "value",
    )


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech ranges of the same recordings: every third event, wider than its segment."""
    s = segments(spark, sf_dir).where("event_id % 3 = 0")
    return s.select("rec_id", F.expr("greatest(0, start - 0.2)").alias("start"), F.expr("end + 0.4").alias("end"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as untimed turns."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"), "text")


#: The same relations for the SQL side, as common table expressions.
SEGMENTS_SQL = """e0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg_idx FROM events),
e1 AS (SELECT *, seg_idx * 2000 + (event_id * 37) % 11 * 100 AS ms, 300 + (event_id * 53) % 29 * 100 AS len FROM e0),
segments AS (SELECT user_id AS rec_id, CAST(seg_idx AS INTEGER) AS seg_idx, event_id, ms / 1000 AS start, (ms + len) / 1000 AS "end",
  CASE WHEN event_id % 7 = 0 THEN '嗯，对' ELSE event_type || ' ' || (event_id % 50) END AS text,
  CASE WHEN event_id % 23 <> 0 THEN event_type END AS speaker,
  CASE WHEN event_id % 5 = 0 THEN 'alt' ELSE event_type END AS predicted, value FROM e1),
ranges AS (SELECT rec_id, greatest(0, start - 0.2) AS start, "end" + 0.4 AS "end" FROM segments WHERE event_id % 3 = 0),
turns AS (SELECT conv_id AS rec_id, turn AS seg_idx, role AS speaker, text FROM conversations)"""
