"""Following a workspace: a first diff against the store, and then micro-batches.

A file source tells of new files only. So the stream is nothing but a clock, with one row a batch: every batch lists the folder and takes
the difference to what the store has, which finds new, changed and deleted files alike, and does nothing twice when a batch is
run again. A batch opens the files that are new or changed, and writes these as a change of the store.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changes
from ..operators.store import Store, build
from ..sources import files as S

LIMIT = 20 << 20
#: Files that a batch opens by their names; beyond, most of a folder is new, and it is scanned as a whole.
BY_NAME = 10_000


def sync(store: Store, root: str, rules: Iterable[S.Rule] = (), most: int = LIMIT, dim: int | None = None) -> dict[str, int]:
    """Brings the store to what is in the folder: adds, replaces and deletes. Files over the limit leave the index. Returns counts."""
    spark = store.spark
    found = S.scan(spark, root, content=False)
    found = found.where(S.matches("path", list(rules))) if rules else found
    small, large = changes.by_size(found, most)
    indexed = store.read()["nodes"].select("path", F.col("st_mtime").alias("mtime"))
    diff = changes.diff(small, indexed).persist()
    try:
        counts = {r["change"]: r["n"] for r in changes.buckets(diff).collect()}
        wanted, n = diff.where("change <> 'deleted'").select("path"), counts.get("added", 0) + counts.get("modified", 0)
        if n > BY_NAME:
            store.change(diff, build(S.texts(S.scan(spark, root).join(wanted, "path", "left_semi"))), dim)
        elif n:
            store.change(diff, build(S.texts(S.scan(spark, root, paths=[r["path"] for r in wanted.collect()]))), dim)
        elif counts:
            store.change(diff)
    finally:
        diff.unpersist()
    return {k: counts.get(k, 0) for k in changes.KINDS}


def reindex(store: Store, root: str, rules: Iterable[S.Rule] = (), most: int = LIMIT) -> dict[str, int]:
    """Clears the store and fills it from the folder."""
    store.clear()
    return sync(store, root, rules, most)


def follow(store: Store, root: str, checkpoint: str, rules: Iterable[S.Rule] = (), seconds: float | None = 5, told: Callable[[int, dict[str, int]], None] | None = None, most: int = LIMIT) -> StreamingQuery:
    """A stream that keeps the store in step with the folder: a look every so many seconds. None: one look, and then it ends."""
    clock = store.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()

    def step(batch: DataFrame, epoch: int) -> None:
        counts = sync(store, root, rules, most)
        if told:
            told(epoch, counts)

    writer = clock.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def apply_events(events: DataFrame, existing: Callable[[], DataFrame], act: Callable[[DataFrame, int], None], checkpoint: str, seconds: float | None = 5) -> StreamingQuery:
    """A stream of (path, change) events, coalesced in each batch to the state that there is."""

    def step(batch: DataFrame, epoch: int) -> None:
        act(changes.coalesce(batch, existing()), epoch)

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def supervised(start: Callable[[], StreamingQuery], tries: int | None = None, first: float = 1, most: float = 60, stable: float = 60, sleep: Callable[[float], None] = time.sleep, rng: random.Random | None = None) -> int:
    """Starts a query again when it fails, after growing pauses with jitter; a run of `stable` seconds resets them. Returns how many starts it
    took until it ended well."""
    rng, pause, n = rng or random.Random(), first, 0
    while True:
        n += 1
        began = time.monotonic()
        try:
            start().awaitTermination()
            return n
        except Exception:
            if tries is not None and n >= tries:
                raise
            pause = first if time.monotonic() - began >= stable else pause
            sleep(pause * rng.uniform(0.5, 1.5))
            pause = min(most, pause * 2)


def once(events: DataFrame, *key: str, at: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows of a stream or table, each key once; with a time column only for as long as rows may be late."""
    return timed(events, at).withWatermark(at, late).dropDuplicatesWithinWatermark(list(key)) if at else events.dropDuplicates(list(key))


def timed(events: DataFrame, at: str) -> DataFrame:
    """Event times as time-zone timestamps, which watermarks need."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def windowed_counts(events: DataFrame, at: str, *key: str, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """An extension: counts of event-time windows, with late rows admitted for a while."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return timed(events, at).withWatermark(at, late).groupBy(w.alias("w"), *key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *key, "n")


def rolling_news(rows: DataFrame, at: str = "event_time", width: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """The rolling window as a stream: counts over the last day, every hour."""
    return windowed_counts(rows, at, width=width, slide=slide, late="1 hour")


def log_changes(changes_df: DataFrame, log: Callable[[str], None]) -> int:
    """Logs a batch's changes one by one, and tells how many there were."""
    n = 0
    for row in changes_df.select("change", "path").toLocalIterator():
        log(f"{row['change']}: {row['path']}")
        n += 1
    return n


def active(spark: SparkSession) -> list[str]:
    return [q.name or str(q.id) for q in spark.streams.active]
