"""What the training-data operators share: byte views of Arrow texts, the shared folder, held-out keys."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps
from inspect import signature

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in blocks of about so many bytes, so that numpy's temporaries stay small.
BLOCK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, local mode gets a
    temporary folder; on a cluster there is no safe default, so it is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quillspark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: its lineage ends, lost executors don't matter."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows (of a few numbers each) that are sent to all executors at most.
SENT_ROWS = 1 << 20


def small_side(df: DataFrame) -> DataFrame:
    """A written table as the smaller side of a join with texts: sent to the texts where its rows are counted and few; beyond, both sides are
    dealt out by their keys."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def delete(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the shared file system, through Spark's own access to it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def hashed_share(key: str, share: float) -> Column:
    """True for about this share of the keys, the same ones on every run."""
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def tidy() -> None:
    """Gives back what a worker's allocators hold for later: workers outlive their tasks, and would keep each one's peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(f: Callable) -> Callable:
    @wraps(f)
    def run(*args: object) -> object:
        try:
            return f(*args)
        finally:
            tidy()

    run.__signature__ = signature(f)  # Spark tells functions with a key by their number of parameters
    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of the column as one byte array, and the n + 1 places where they begin. Null: empty."""
    column = column.fill_null("").cast(pa.large_string())
    n, off = len(column), column.offset
    _, offsets, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[off : off + n + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `size` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, at = utf8(batch.column(text))
        start = 0
        while start < n:
            end = max(start + 1, int(np.searchsorted(at, at[start] + size, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    tidy()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (uint64 in and out)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i+1]] in double precision, 0 for empty segments."""
    out = np.zeros((len(at) - 1,) + values.shape[1:], np.float64)
    some = np.flatnonzero(at[1:] > at[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, at[some], axis=0, dtype=np.float64)
    return out
