"""Ranking, top-k, sampling and de-duplication by windows and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def top_per(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """k rows of each group; Spark limits each group before the shuffle."""
    return ranked(rows, by, order, "_r").where(F.col("_r") <= k).drop("_r")


def quota_then_fill(rows: DataFrame, by: str, order: Sequence[Column | str], quota: int, limit: int) -> DataFrame:
    """Each group's first rows, then the best of the rest, up to the limit."""
    r = ranked(rows, [by], order, "_r")
    return r.orderBy((F.col("_r") > quota).cast("int"), *order).limit(limit).drop("_r")


def sample_stratified(rows: DataFrame, by: Sequence[str], key: str, k: int, seed: str) -> DataFrame:
    """k rows of each stratum by a hash of seed and key: the same rows each time."""
    return top_per(rows, by, [F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), F.col(key)], k)


def hash_order(rows: DataFrame, key: str, seed: str, limit: int) -> DataFrame:
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    return rows.withColumn("selection", digest).orderBy("selection").limit(limit)


def keep_best(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key, with how many there were."""
    w = W.partitionBy(*by)
    return ranked(rows, by, order, "_r").withColumn("copies", F.count("*").over(w)).where("_r = 1").drop("_r")


def multiset_difference(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of left that right has as well, and those that it hasn't, counting repeats."""
    return left.intersectAll(right), left.exceptAll(right)


def merge_items(rows: DataFrame, key: Sequence[str], order: str, first: Sequence[str], union: str) -> DataFrame:
    """One row per key: first non-null values in order, and the union of lists in order of appearance."""
    sort = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda x: x[c])
    head = lambda c: F.try_element_at(F.filter(sort(c), lambda x: x.isNotNull()), F.lit(1)).alias(c)
    return rows.groupBy(*key).agg(*map(head, first), F.array_distinct(F.flatten(sort(union))).alias(union))
