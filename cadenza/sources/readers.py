"""Readers: transcripts, annotations, term lists, tables and articles, from files as Spark reads them.

Lenient readers drop what can't be read; strict ones raise through ``raise_error``. Text
readers take a DataFrame with a column value (and file, for whole files), so that they work on any
source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEGMENT = "struct<start:double,end:double,duration:double,text:string,original_text:string,speaker:string,speaker_id:string,label:string,speakers:array<string>,speaker_ids:array<string>,uri:string>"
MAX_TERM = 48


def transcript_json(df: DataFrame, value: str = "value") -> DataFrame:
    """Segments of transcript documents: the first of four container keys that is there."""
    keys = ("segments", "diarization_segments", "speaker_segments")
    doc = F.from_json(value, ", ".join(f"{k} array<{SEGMENT}>" for k in keys) + f", diarization struct<segments:array<{SEGMENT}>>, uri string, audio string")
    rows = df.withColumn("_d", doc).withColumn("_s", F.coalesce(*(F.col(f"_d.{k}") for k in keys), F.col("_d.diarization.segments")))
    return rows.select("*", F.coalesce("_d.uri", "_d.audio").alias("root"), F.posexplode("_s").alias("seg_idx", "s")).drop("_d", "_s")


def annotations(df: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(uri, start, end, speaker) of transcript documents; rows with several speakers give one each; a bad time raises."""
    rows = transcript_json(df, value)
    end = F.coalesce("s.end", F.col("s.start") + F.col("s.duration"))
    one = F.coalesce("s.speaker", "s.speaker_id", "s.label")
    many = F.coalesce(F.when(one.isNotNull(), F.array(one)), F.col("s.speakers"), F.col("s.speaker_ids"))
    rows = rows.select(F.coalesce("s.uri", "root", F.col(key).cast("string")).alias("uri"), F.col("s.start").alias("start"), end.alias("end"), F.explode(many).alias("speaker"))
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("end") <= F.col("start"))
    return rows.withColumn("start", F.when(bad, F.raise_error(F.concat(F.lit("invalid time in "), F.col("uri"))).cast("double")).otherwise(F.col("start")))


def rttm(lines: DataFrame, value: str = "value") -> DataFrame:
    """(uri, start, end, speaker) of SPEAKER lines; comments and blank lines skipped; another line raises."""
    t = lines.select(F.trim(value).alias("line")).where("line <> '' AND line NOT LIKE '#%'")
    f = F.split("line", r"\s+")
    start, dur = f[3].try_cast("double"), f[4].try_cast("double")
    good = (F.size(f) >= 8) & (F.upper(f[0]) == "SPEAKER") & (start >= 0) & (dur > 0)
    checked = F.when(F.coalesce(good, F.lit(False)), start).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col("line"))).cast("double"))
    return t.select(f[1].alias("uri"), checked.alias("start"), (start + dur).alias("end"), f[7].alias("speaker"))


def terms(df: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Term lists: comments and bullets stripped, split at commas, first place of each term, overlong ones dropped."""
    lines = df.select(key, F.posexplode(F.split(value, "\n")).alias("i", "line"))
    lines = lines.select(key, "i", F.trim(F.regexp_replace("line", "#.*$", "")).alias("line")).where("line <> ''")
    parts = lines.select(key, "i", F.posexplode(F.split("line", "[,，、;；\t]")).alias("j", "term"))
    parts = parts.select(key, "i", "j", F.trim(F.regexp_replace("term", r"^\s*[-*•]\s+", "")).alias("term")).where(f"term <> '' AND length(term) <= {MAX_TERM}")
    first = parts.groupBy(key, "term").agg(F.min(F.struct("i", "j")).alias("at"))
    return first.select(key, "term", F.row_number().over(W.partitionBy(key).orderBy("at")).alias("place"))


def frontmatter(text: str | Column) -> tuple[Column, Column]:
    """Fields (a map) and body of a text that may begin with --- lines."""
    c = F.col(text) if isinstance(text, str) else text
    head = F.regexp_extract(c, r"(?s)\A---\n(.*?)\n---\n?", 1)
    fields = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    entries = F.transform(fields, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    return F.map_from_entries(entries), F.regexp_replace(c, r"(?s)\A---\n.*?\n---\n?", "")


def markdown_table(lines: DataFrame, value: str = "value") -> DataFrame:
    """Cells of table rows, without rulers."""
    t = lines.select(F.trim(value).alias("line")).where(r"line LIKE '|%' AND NOT line RLIKE '^\\|[-: |]+\\|$'")
    inner = F.regexp_replace("line", r"^\||\|$", "")
    return t.select(F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells"))


def gold_rows(df: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, row_key, place, row) of gold templates: a JSON list, or a list under items, rows or segments; another shape raises.

    A row is a map of strings. CSV templates are read with Spark's reader, with header.
    """
    row = "array<map<string,string>>"
    whole = F.regexp_replace(value, "^\\x{feff}", "")
    listed = F.trim(whole).startswith("[")
    doc = F.from_json(F.when(~listed, whole), f"items {row}, rows {row}, segments {row}")
    rows = df.select(key, F.from_json(F.when(listed, whole), row).alias("_l"), doc.alias("_d"))
    names = ("items", "rows", "segments")
    named = F.when(F.col("_l").isNotNull(), "list")
    for n in names:
        named = named.when(F.col(f"_d.{n}").isNotNull(), n)
    found = F.coalesce("_l", *(F.col(f"_d.{n}") for n in names), F.raise_error(F.lit("not a gold template")).cast(row))
    return rows.select(key, named.alias("row_key"), F.posexplode(found).alias("place", "row")).where("row IS NOT NULL")


#: Endings of audio files.
AUDIO = "wav|mp3|m4a|flac|aac|ogg|opus|mp4|mov"


def audio_references(df: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, audio): all strings of JSON texts, at any depth, that name an audio file."""
    found = F.regexp_extract_all(F.col(value), F.lit(rf'(?i)"((?:[^"\\\\]|\\\\.)*\.(?:{AUDIO}))"\s*(?=[,\]}}]|$)'), F.lit(1))
    return df.select(key, F.explode(found).alias("audio"))


def library(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of all tasks below a folder, newest first; corrupt files are skipped."""
    df = spark.read.option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
    return df.orderBy(F.desc("updated_at"))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files below a folder with their fields and body."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("wholetext", True).text(path)
    fields, body = frontmatter("value")
    return df.select(F.col("_metadata.file_path").alias("file"), fields.alias("fields"), body.alias("body"))
