"""Rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60


def reciprocal(vector_weight: float, k: int = K, vector_rank: str = "vector_rank", keyword_rank: str = "keyword_rank") -> Column:
    """The weighted sum of reciprocal ranks; a list that has no such row adds nothing."""
    part = lambda w, rank: F.coalesce(F.lit(w) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    return part(vector_weight, vector_rank) + part(1.0 - vector_weight, keyword_rank)


def fuse(vector: DataFrame, keyword: DataFrame, vector_weight: float = 0.7, id: str = "id", k: int = K) -> DataFrame:
    """id, score, vector, keyword, vector_rank, keyword_rank of two bounded lists (id, score, rank): weighted reciprocal ranks."""
    a = vector.select(F.col(id).alias("a"), F.col("score").alias("vector"), F.col("rank").alias("vector_rank"))
    b = keyword.select(F.col(id).alias("b"), F.col("score").alias("keyword"), F.col("rank").alias("keyword_rank"))
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return both.select(F.coalesce("a", "b").alias(id), reciprocal(vector_weight, k).alias("score"), "vector", "keyword", "vector_rank", "keyword_rank")


def fused_order() -> list:
    """Best first; on ties what the vector list had, in its order, and then the keyword list's own."""
    return [F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank")]


def first_per(rows: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """The best-ranked row of each key, ranked anew. For bounded lists."""
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(rank))).where("nth = 1").drop("nth")
    return first.withColumn(rank, F.row_number().over(Window.orderBy(rank)))


def fuse_nodes(vector: DataFrame, keyword: DataFrame, vector_weight: float = 0.7, key: str = "path", k: int = K) -> DataFrame:
    """key, score of two bounded lists (key, rank) with one row for each key."""
    each = vector.select(key, (F.lit(vector_weight) / (k + F.col("rank"))).alias("part")).unionByName(keyword.select(key, (F.lit(1.0 - vector_weight) / (k + F.col("rank"))).alias("part")))
    return each.groupBy(key).agg(F.sum("part").alias("score"))
