"""Ranges of lines: merging, cover tests, unions of overlapping passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def islands(rows: DataFrame, *key: str, low: str = "start_line", high: str = "end_line") -> DataFrame:
    """rows with `island`, a number for each run of ranges of a key that overlap or touch."""
    order = Window.partitionBy(*key).orderBy(low, high)
    before = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(low) > before + 1), 1).otherwise(0)
    return rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def merge(rows: DataFrame, *key: str, low: str = "start_line", high: str = "end_line") -> DataFrame:
    """The key's ranges with those that overlap or touch joined."""
    return islands(rows, *key, low=low, high=high).groupBy(*key, "island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("island")


def uncovered(rows: DataFrame, seen: DataFrame, *key: str, low: str = "start_line", high: str = "end_line") -> DataFrame:
    """Rows whose range doesn't lie within what the seen ranges of their key cover together; what they only overlap stays."""
    held = merge(seen, *key, low=low, high=high).select(*[F.col(k).alias(f"_{k}") for k in key], F.col(low).alias("_low"), F.col(high).alias("_high"))
    match = (F.col("_low") <= F.col(low)) & (F.col(high) <= F.col("_high"))
    for k in key:
        match = match & (F.col(k) == F.col(f"_{k}"))
    return rows.join(held, match, "left_anti")


def live(seen: DataFrame, now: float, ttl: float, at: str = "ts") -> DataFrame:
    """What was seen under `ttl` seconds ago."""
    return seen.where(F.lit(now) - F.col(at) < ttl)


def by_path(rows: DataFrame, path: str = "path", rank: str = "rank", low: str = "start_line") -> DataFrame:
    """Passages of a path side by side in line order; paths in the order of their best passage."""
    return rows.withColumn("path_rank", F.min(rank).over(Window.partitionBy(path))).orderBy("path_rank", low)


def union_passages(rows: DataFrame, *key: str) -> DataFrame:
    """Of passages (start_line, end_line, text, score; text line i is line start_line + i) those that overlap or touch as one: each line
    once, taken from the passage that begins last; score and the rest of the row from the best passage."""
    order = F.struct("score", -F.col("start_line"), -F.col("end_line"))
    best = [c for c in rows.columns if c not in (*key, "start_line", "end_line", "text")]
    item = F.struct("start_line", "end_line", X.lines("text").alias("lines"))
    grouped = islands(rows, *key).groupBy(*key, "island").agg(
        F.count("*").alias("n"), F.first("text").alias("text"), F.array_sort(F.collect_list(item)).alias("items"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), *[F.max_by(c, order).alias(c) for c in best],
    )
    numbered = F.flatten(F.transform("items", lambda it, k: F.transform(it["lines"], lambda line, i: F.struct((it["start_line"] + i).alias("no"), k.alias("k"), line.alias("line")))))
    spread = grouped.withColumn("spread", F.array_sort(numbered)).withColumn("last", F.size("spread") - 1)
    kept = F.filter("spread", lambda x, i: (i == F.col("last")) | (F.get("spread", i + 1)["no"] != x["no"]))
    whole = F.array_join(F.transform(kept, lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return spread.withColumn("text", F.when(F.col("n") == 1, F.col("text")).otherwise(whole)).select(*rows.columns)
