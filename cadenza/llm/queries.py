"""The training-data queries and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from cadenza.llm import bpe, ngram_join, ogg, packing, quality, secrets, topk, toxicity, urlfilter, warc
from cadenza.llm.common import stored, table


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(warc.write_warc(warc.with_roles(table(spark, sf_dir, "pages"))), "warc-archives")
    return warc.read_warc(archives)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.read_ogg(ogg.write_ogg(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), with_links=True)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors, 10)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_warc, op3_toxicity, op4_packing, op5_quality, op6_secrets, op7_ogg, op8_ngram_jaccard, op9_url_filter, op10_top_k)}

ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
             d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS g FROM p),
             k AS (SELECT g, max(page_id) AS keeper FROM d WHERE n >= 1000 GROUP BY g)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.g AS payload_digest,
               CASE WHEN keeper IS NOT NULL AND page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN keeper IS NOT NULL AND page_id < keeper THEN keeper END AS refers_to
        FROM d LEFT JOIN k ON d.g = k.g AND d.n >= 1000""",
    "op10_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
                   FROM embeddings WHERE embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                          CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
}
