"""Evaluation: accuracy, rubric scores, order agreement, usage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, kind: str, correct: Column) -> DataFrame:
    """kind, correct, total, accuracy in percent."""
    return rows.groupBy(kind).agg(F.sum(correct.cast("int")).cast("long").alias("correct"), F.count("*").alias("total"), (F.avg(correct.cast("double")) * 100).alias("accuracy"))


def rubric(rows: DataFrame, kind: str, scores: str = "scores", score: str = "score") -> DataFrame:
    """kind, score, binary_score, n: mean score, and mean share of items with a full score (without items: whether the score is above 0.99)."""
    share = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.when(x >= 1.0, 1.0).otherwise(0.0)) / F.size(scores)
    binary = F.when(F.size(F.coalesce(scores, F.array().cast("array<double>"))) > 0, share).otherwise(F.when(F.col(score) > 0.99, 1.0).otherwise(0.0))
    return rows.groupBy(kind).agg(F.avg(score).alias("score"), F.avg(binary).alias("binary_score"), F.count("*").alias("n"))


def mean_std(rows: DataFrame, *key: str, value: str) -> DataFrame:
    """Mean and population standard deviation."""
    return rows.groupBy(*key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def latest_status(rows: DataFrame, key: str, status: str, *order: str) -> DataFrame:
    """Each key's status in its last row by the given columns."""
    return rows.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status))


def pair_counts(rows: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """key, n, concordant, discordant, x_ties, y_ties over all pairs of a key's rows, without making any pair. Of two different ranks in y the
    highest bit in which they differ tells which is greater, and ranks with equal bits above it share a group. So for each bit a running
    count along x tells how many rows of a group with the other value of the bit come before: n rows cost n times the bits of n."""
    each = rows.groupBy(key, x, y).agg(F.count("*").alias("c"))
    by = Window.partitionBy(key)
    ranked = each.select(key, "c", F.dense_rank().over(by.orderBy(x)).alias("rx"), (F.dense_rank().over(by.orderBy(y)) - 1).alias("ry"))
    bits = F.length(F.bin(F.max("ry").over(by)))
    bit = ranked.withColumn("bits", bits).select(key, "c", "rx", "ry", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)).alias("level"))
    bit = bit.withColumn("above", F.expr("shiftright(ry, level + 1)")).withColumn("set", F.expr("shiftright(ry, level) & 1"))
    before = Window.partitionBy(key, "level", "above").orderBy("rx").rangeBetween(Window.unboundedPreceding, -1)
    count = lambda value: F.coalesce(F.sum(F.when(F.col("set") == value, F.col("c")).otherwise(0)).over(before), F.lit(0))
    passed = bit.withColumn("low", count(0)).withColumn("high", count(1))
    pairs = passed.groupBy(key).agg(F.sum(F.when(F.col("set") == 1, F.col("c") * F.col("low")).otherwise(0)).alias("concordant"), F.sum(F.when(F.col("set") == 0, F.col("c") * F.col("high")).otherwise(0)).alias("discordant"))

    def ties(column: str, name: str) -> DataFrame:
        own = rows.groupBy(key, column).agg(F.count("*").alias("c"))
        return own.groupBy(key).agg(F.sum("c").alias(f"n_{name}"), F.sum((F.col("c") * (F.col("c") - 1) / 2).cast("long")).alias(name))

    out = ties(x, "x_ties").withColumnRenamed("n_x_ties", "n").join(ties(y, "y_ties").drop("n_y_ties"), key).join(pairs, key)
    return out.select(key, "n", "concordant", "discordant", "x_ties", "y_ties")


def kendall(rows: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """key, tau: rank agreement; pairs tied in both orders count in both ties; 0 where it isn't defined."""
    c = pair_counts(rows, key, x, y)
    n0 = F.col("n") * (F.col("n") - 1) / 2
    room = (n0 - F.col("x_ties")) * (n0 - F.col("y_ties"))
    return c.select(key, F.when((F.col("n") < 2) | (room <= 0), F.lit(0.0)).otherwise((F.col("concordant") - F.col("discordant")) / F.sqrt(room)).alias("tau"))


def order_score(rows: DataFrame, key: str, reference: str = "reference", system: str = "system") -> DataFrame:
    """key, precision, recall, f1, tau_norm, final_score of two arrays of events, already aligned: found events, and how their order agrees
    over the union (events that a list lacks are last in it)."""
    union = F.array_distinct(F.concat(reference, system))
    both = rows.select(key, reference, system, union.alias("u"))
    place = lambda seq: F.transform("u", lambda e: F.when(F.array_contains(seq, e), F.size(seq) + 1 - F.array_position(F.reverse(F.col(seq)), e)).otherwise(F.size("u") + 1))
    ranks = both.select(key, F.explode(F.arrays_zip(place(reference).alias("x"), place(system).alias("y"))).alias("r")).select(key, "r.x", "r.y")
    tau = kendall(ranks, key)
    hits = F.size(F.array_intersect(reference, system))
    extra = F.size(F.filter(system, lambda e: ~F.array_contains(reference, e)))
    missed = F.size(F.filter(reference, lambda e: ~F.array_contains(system, e)))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    scored = both.select(key, share(hits, hits + extra).alias("precision"), share(hits, hits + missed).alias("recall"))
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    joined = scored.withColumn("f1", f1).join(tau, key, "left").withColumn("tau_norm", (F.coalesce("tau", F.lit(0.0)) + 1) / 2)
    return joined.select(key, "precision", "recall", "f1", "tau_norm", (F.col("tau_norm") * F.col("f1")).alias("final_score"))


def align_by_cosine(rows: DataFrame, key: str, least: float = 0.65) -> DataFrame:
    """key, aligned of rows (key, reference, system: arrays of texts; reference_vectors, system_vectors): each system event becomes the reference
    event that it is nearest to, if near enough and not taken by one before it. The choices depend on each other, so they are made per row."""
    import numpy as np

    def run(batches):
        for batch in batches:
            out = []
            for ref, own, rv, sv in zip(*(batch.column(c).to_pylist() for c in ("reference", "system", "reference_vectors", "system_vectors")), strict=True):
                if ref and own:
                    r, s = np.array(rv, float), np.array(sv, float)
                    sims = (s / (np.linalg.norm(s, axis=1, keepdims=True) + 1e-12)) @ (r / (np.linalg.norm(r, axis=1, keepdims=True) + 1e-12)).T
                    taken: set[int] = set()
                    named = []
                    for text, row in zip(own, sims, strict=True):
                        best = int(row.argmax())
                        fine = row[best] >= least and best not in taken
                        named.append(ref[best] if fine else text)
                        taken |= {best} if fine else set()
                    own = named
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.string()))], names=["key", "aligned"])

    picked = rows.select(F.col(key).cast("string").alias("key"), "reference", "system", "reference_vectors", "system_vectors")
    return picked.mapInArrow(run, "key string, aligned array<string>")


def token_usage(rows: DataFrame, *key: str) -> DataFrame:
    """Sums of input and output tokens, each by either of its names; nothing said is nothing, and a total is always their sum."""
    named = lambda a, b: F.coalesce(F.col(a), F.col(b))
    have = rows.columns
    pick = lambda a, b: named(a, b) if a in have and b in have else F.col(a if a in have else b)
    sums = rows.groupBy(*key).agg(F.sum(pick("input_tokens", "prompt_tokens")).alias("input_tokens"), F.sum(pick("output_tokens", "completion_tokens")).alias("output_tokens"))
    return sums.withColumn("total_tokens", F.when(F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull(), F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))))


def counter_delta(start: DataFrame, end: DataFrame, *key: str, value: str = "value") -> DataFrame:
    """What counters grew by; one that either side lacks stays null."""
    a = start.select(*key, F.col(value).alias("was"))
    return a.join(end.select(*key, F.col(value).alias("now")), list(key), "full_outer").select(*key, (F.col("now") - F.col("was")).alias("delta"))


def counters(deltas: DataFrame, path: str = "path", value: str = "delta") -> DataFrame:
    """path (array), value: sums of a log of additions."""
    return deltas.groupBy(path).agg(F.sum(value).alias("value"))


def subtree(totals: DataFrame, prefix: list[str], path: str = "path") -> DataFrame:
    return totals.where(F.slice(path, 1, max(1, len(prefix))) == F.array(*map(F.lit, prefix))) if prefix else totals


def previous_values(deltas: DataFrame, path: str = "path", value: str = "delta", order: str = "seq") -> DataFrame:
    """deltas with `previous`: the counter's value before each addition."""
    w = Window.partitionBy(path).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return deltas.withColumn("previous", F.coalesce(F.sum(value).over(w), F.lit(0)))


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows of some tables."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out
