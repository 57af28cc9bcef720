"""The change feed: from two snapshots or a batch of events to what has to be done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("added", "modified", "deleted")


def diff(existing: DataFrame, indexed: DataFrame, version: str = "mtime") -> DataFrame:
    """path, change of two snapshots (path, version)."""
    a = existing.select("path", F.col(version).alias("now"), F.lit(True).alias("here"))
    b = indexed.select("path", F.col(version).alias("was"), F.lit(True).alias("known"))
    change = F.when(F.col("known").isNull(), "added").when(F.col("here").isNull(), "deleted").when(~F.col("now").eqNullSafe(F.col("was")), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def coalesce(events: DataFrame, existing: DataFrame) -> DataFrame:
    """path, change of a batch of events (path, change): what is there now decides, not the events' order."""
    seen = events.where(F.col("change").isin(*KINDS)).groupBy("path").agg(F.collect_set("change").alias("kinds"))
    here = existing.select("path", F.lit(True).alias("here")).distinct()
    change = F.when(F.col("here").isNull(), "deleted").when(F.col("kinds") == F.array(F.lit("added")), "added").otherwise("modified")
    return seen.join(here, "path", "left").select("path", change.alias("change"))


def buckets(changes: DataFrame) -> DataFrame:
    """One row: the paths of each kind of change in order, and how many there are."""
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def consistency(declared: DataFrame, stored: DataFrame, id: str = "id") -> DataFrame:
    """One row: ids that are declared and not stored (missing), and the other way round (orphaned)."""
    a, b = declared.select(id).distinct(), stored.select(id).distinct()
    missing = a.join(b, id, "left_anti").agg(F.count("*").alias("missing"))
    return missing.join(b.join(a, id, "left_anti").agg(F.count("*").alias("orphaned")))


def out_of_sync(expected: DataFrame, live: DataFrame, id: str = "id") -> DataFrame:
    """Ids that an index lacks or has too many: id, state. expected: only what can be indexed."""
    a, b = expected.select(id).distinct(), live.select(id).distinct()
    return a.join(b, id, "left_anti").withColumn("state", F.lit("missing")).unionByName(b.join(a, id, "left_anti").withColumn("state", F.lit("stale")))


def window_diff(existing: DataFrame, indexed: DataFrame, days: list[str], daily: str = "daily", topics: str = "interests", topic_files: DataFrame | None = None, version: str = "mtime") -> DataFrame:
    """path, state (changed, unchanged, deleted) of the days' notes against the catalog; topic files are no notes, and as long as they
    are there (topic_files: path) they aren't deleted either."""
    inside = F.lit(False)
    for day in days:
        inside = inside | (F.col("path") == f"{daily}/{day}.md") | F.col("path").startswith(f"{daily}/{day}/")
    special = F.col("path").isin([f"{daily}/{d}/{topics}.yaml" for d in days])
    a = existing.where(inside & ~special).select("path", F.col(version).alias("now"), F.lit(True).alias("here"))
    b = indexed.where(inside).select("path", F.col(version).alias("was"))
    both = a.join(b, "path", "full_outer")
    if topic_files is not None:
        both = both.join(topic_files.where(special).select("path"), "path", "left_anti")
    state = F.when(F.col("here").isNull(), "deleted").when(F.col("now").eqNullSafe(F.col("was")), "unchanged").otherwise("changed")
    return both.select("path", state.alias("state"))


def by_size(files: DataFrame, most: int = 20 << 20, size: str = "length") -> tuple[DataFrame, DataFrame]:
    """Files to index, and files too large for it, whose rows go from the index."""
    return files.where(F.col(size) <= most), files.where(F.col(size) > most)


def batches(files: DataFrame, most_files: int = 100, most_bytes: int = 512 << 20, size: str = "length") -> DataFrame:
    """files with `batch`: about most_files files and most_bytes bytes each, by hash; the bounds hold on average."""
    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    groups = F.greatest(F.ceil(F.col("n") / most_files), F.ceil(F.col("bytes") / most_bytes), F.lit(1))
    return files.join(F.broadcast(total.select(groups.alias("groups")))).withColumn("batch", F.pmod(F.xxhash64("path"), F.col("groups"))).drop("groups")
