"""A corpus pipeline: each stage takes the documents that the one before kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents. run()
writes each stage's documents as Parquet in the shared scratch folder and reads them back.

Edge cases, of all stages: documents without text are kept by the first two stages if they score
like clean ones, have no near duplicate, no secret, and pack as an end mark alone. Documents
without an id are nobody's duplicate. Rows that repeat an id with its text are copies, of which one
stays; rows that repeat an id with other texts are documents of their own. Texts are taken whole,
however long. An empty table gives an empty table. Further columns, whatever their names, are
carried along unread. Ties: a score equal to a threshold counts as the stage's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import ngram_join, packing, quality, secrets, toxicity
from cadenza.llm.common import fresh, stored, table
from cadenza.llm.queries import TOKENIZER


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on those among docs with a label, doesn't reject: of scores below the threshold.

    Without labels of both classes all stay; empty texts are scored as such.
    """
    net, score = toxicity.trained(docs, table(spark, sf_dir, "labels")), fresh(docs, "score")
    return toxicity.score_texts(docs, net, score_col=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject: of scores that reach the threshold.

    Without labels of both classes all stay; empty texts are scored as such.
    """
    model, score = quality.trained(docs, table(spark, sf_dir, "labels")), fresh(docs, "score")
    return quality.score_texts(docs, model, score_col=score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the row of least id and, under that, of least text hash; one of rows that are equal.

    Rows without an id and rows without words are nobody's duplicate; of those that repeat an id and its text one stays.
    """
    tag, key, tags, times = (fresh(docs, x) for x in ("tag", "near_id", "near_tag", "near_times"))
    tagged = docs.withColumn(tag, F.xxhash64("text"))
    found = stored(ngram_join.jaccard_components(tagged, tag_col=tag).where("doc_id is not null").select("doc_id", "tag", "group_id"), "near-rows")
    first = found.groupBy("group_id").agg(F.min(F.struct("doc_id", "tag")).alias("x")).select("x.*").distinct()
    count = found.groupBy("doc_id", "tag").agg(F.count("*").alias(times))
    stay = stored(first.join(count, ["doc_id", "tag"]).select(F.col("doc_id").alias(key), F.col("tag").alias(tags), times), "near-stay")
    rows = tagged.join(stay, (F.col("doc_id") == F.col(key)) & (F.col(tag) == F.col(tags)))
    once, more = rows.where(F.col(times) == 1), rows.where(F.col(times) > 1).dropDuplicates([key, tags])
    return once.select(*docs.columns).unionByName(more.select(*docs.columns)).unionByName(docs.where("doc_id is null"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that the scan reports replaced in their texts; null and empty texts stay as they are."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").contains(secrets.MASK), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces and their places in sequences; null and empty texts are an end mark alone."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: The classifiers are learnt; SQL can't express their stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
