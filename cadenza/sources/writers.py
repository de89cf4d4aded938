"""Exports: one row (rec_id, content) per recording, to be written as text or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from cadenza.functions.text import clock

def order() -> WindowSpec:
    return W.partitionBy("rec_id").orderBy("seg_idx")


def joined(rows: DataFrame, line: str | Column, sep: str, name: str = "content") -> DataFrame:
    """Lines of a recording in order, and how many."""
    c = F.col(line) if isinstance(line, str) else line
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", c.alias("line")))), lambda x: x["line"])
    return rows.groupBy("rec_id").agg(F.array_join(lines, sep).alias(name), F.count("*").alias("rows"))


def txt(segments: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), clock("start"), F.lit(" - "), clock("end"), F.lit("] "), F.trim("text"))
    return joined(segments.where("trim(text) <> ''"), line, "\n").select("rec_id", F.concat("content", F.lit("\n")).alias("content"))


def srt(segments: DataFrame) -> DataFrame:
    """Subtitles, numbered after blank ones are gone."""
    rows = segments.where("trim(text) <> ''").withColumn("k", F.row_number().over(order()))
    block = F.concat_ws("\n", "k", F.concat(clock("start", True), F.lit(" --> "), clock("end", True)), F.trim("text"), F.lit(""))
    return joined(rows, block, "\n").drop("rows")


def markdown(segments: DataFrame) -> DataFrame:
    """Anchored lines with a heading where the speaker changes."""
    new = F.row_number().over(order()).eqNullSafe(1) | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(order()))
    head = F.when(new, F.concat(F.lit("## "), F.coalesce("speaker", F.lit("?")), F.lit("\n"))).otherwise("")
    anchor = F.concat(F.lit('<a id="t-'), F.floor(F.col("start") * 1000 + 1e-6).cast("string"), F.lit('"></a>'))
    rows = segments.withColumn("line", F.concat(head, anchor, "text"))
    return joined(rows, "line", "\n").drop("rows")


def named(segments: DataFrame) -> DataFrame:
    """Segments whose text begins with the speaker in brackets; blank texts stay blank."""
    said = F.when(F.trim("text") == "", "").otherwise(F.concat(F.concat(F.lit("["), "speaker", F.lit("] ")), F.trim("text")))
    return segments.withColumn("text", F.when(F.col("speaker").isNull() | (F.col("speaker") == ""), F.col("text")).otherwise(said))


def document(segments: DataFrame, *fields: str) -> DataFrame:
    """One JSON document per recording; fields without a value are left out."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col("seg_idx").alias("_at"), F.struct(*fields).alias("s")))), lambda x: x["s"])
    return segments.groupBy("rec_id").agg(F.to_json(F.struct(rows.alias("segments"))).alias("content"))


def tsv(segments: DataFrame, *fields: str) -> DataFrame:
    """A heading and tab-separated rows; tabs and line ends within values become blanks."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ")
    rows = joined(segments, F.concat_ws("\t", *(cell(f) for f in fields)), "\n")
    return rows.select("rec_id", F.concat(F.lit("\t".join(fields) + "\n"), "content").alias("content"))


def save(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write with Spark's committer: all files of a job appear or none."""
    out = df.write.mode("overwrite")
    {"json": out.json, "parquet": out.parquet, "tsv": lambda p: out.option("sep", "\t").option("header", True).csv(p), "text": out.text}[kind](path)
