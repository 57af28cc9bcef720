"""Exact vector search, and upkeep of vectors. An approximate search is in ann."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import vectors as V
from .lineage import kept


def literal(vector: Sequence[float]):
    return F.array(*[F.lit(float(x)) for x in vector])


def cosines(rows: DataFrame, query: Sequence[float], embedding: str = "embedding") -> DataFrame:
    """rows with score, the cosine with the query; rows without a vector of its size are left out."""
    fits = rows.where(F.col(embedding).isNotNull() & (F.size(embedding) == len(query)))
    return fits.withColumn("score", V.cosine(embedding, literal(query)))


def top_k(rows: DataFrame, query: Sequence[float], k: int, *ties: str, embedding: str = "embedding") -> DataFrame:
    """The k nearest rows: each task keeps its k best, and those meet. The vectors don't leave their tasks."""
    return cosines(rows, query, embedding).drop(embedding).orderBy(F.desc("score"), *ties).limit(max(0, k))


#: Queries that travel to the rows at once, and pairs of a task, in expectation.
ASKED, PAIRS = 4096, 1 << 21


def by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """Places of vectors of one size, the vectors as rows, and their lengths; None for those that are null or hold nulls."""
    size = np.array([len(v.values) if v.is_valid and not v.values.null_count else -1 for v in column], np.int64)
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        if n < 0:
            yield own, None, None
        else:
            x = column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), n)
            yield own, x, np.sqrt((x * x).sum(1))


def cosine_pairs(rows: DataFrame, queries: DataFrame, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """query_id, id, score of a stated set of queries (id, embedding) with all rows, as V.cosine has it: 0 where either is zero, null where
    sizes differ. Blocks of about ASKED queries travel to the rows, which are dealt out to tasks by the number of pairs; a task multiplies
    matrices and holds one block and a batch of rows."""
    session = rows.sparkSession
    asked = queries.select(id, embedding)
    blocks = max(1, -(-queries.count() // ASKED))
    own = [asked] if blocks == 1 else [asked.where(F.pmod(F.xxhash64(id, embedding), F.lit(blocks)) == k) for k in range(blocks)]
    tasks = max(1, min(10_000, -(-rows.count() * ASKED // PAIRS)))
    dealt = rows.select(id, embedding).repartition(tasks)
    kind = rows.schema[id].dataType

    def against(block: DataFrame) -> DataFrame:
        table = block.toArrow().combine_chunks()
        sent = session.sparkContext.broadcast((_flat(table.column(0)), list(by_size(_flat(table.column(1))))))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, groups = sent.value
            for batch in batches:
                ids = batch.column(0)
                mine = list(by_size(batch.column(1)))
                for at, x, size in groups:
                    for places, y, sizes in mine:
                        step = max(1, (1 << 18) // len(places))
                        for k in range(0, len(at), step):
                            part = at[k : k + step]
                            score = None
                            if x is not None and y is not None and x.shape[1] == y.shape[1]:
                                with np.errstate(all="ignore"):
                                    both = size[k : k + step, None] * sizes
                                    score = np.where(both == 0, 0.0, (x[k : k + step] @ y.T) / both).ravel()
                            n = len(part) * len(places)
                            yield pa.RecordBatch.from_arrays([
                                query_ids.take(pa.array(np.repeat(part, len(places)))),
                                ids.take(pa.array(np.tile(places, len(part)))),
                                pa.nulls(n, pa.float64()) if score is None else pa.array(score),
                            ], names=["query_id", id, "score"])

        return dealt.mapInArrow(compare, StructType([StructField("query_id", kind), StructField(id, kind), StructField("score", DoubleType())]))

    return reduce(DataFrame.unionByName, [against(block) for block in own])


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def missing_vectors(chunks: DataFrame, dim: int, embedding: str = "embedding") -> DataFrame:
    """Chunks that need a vector: without one, or of another size."""
    return chunks.where(F.col(embedding).isNull() | (F.size(embedding) != dim))


def reuse_vectors(new: DataFrame, old: DataFrame, dim: int) -> DataFrame:
    """New chunks (id, text, ...) with the vectors of old ones of equal id and text and the right size; else null."""
    held = old.where(F.size("embedding") == dim).select("id", "text", F.col("embedding").alias("embedding")).dropDuplicates(["id", "text"])
    return new.drop("embedding").join(held, ["id", "text"], "left")


def space_id(model: str, endpoint: str, dim: int) -> str:
    """A name of the space that a model's vectors lie in; vectors of different spaces aren't compared."""
    return hashlib.sha256(json.dumps([model, endpoint.rstrip("/"), dim]).encode()).hexdigest()[:16]


def backfilled(chunks: DataFrame, cache: DataFrame, space: str, dim: int, embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """chunks (id, text, embedding, ...) in which every one has a vector of the right size: its own, else that of its text in the cache (space,
    key, embedding), else a new one; each text is embedded once. And the cache's new rows."""
    key = F.sha2("text", 256)
    need = missing_vectors(chunks, dim).select(key.alias("key"), "text").distinct()
    known = cache.where((F.col("space") == space) & (F.size("embedding") == dim)).select("key", F.col("embedding").alias("held")).dropDuplicates(["key"])
    fresh = kept(need.join(known, "key", "left_anti").select(F.lit(space).alias("space"), "key", embed(F.col("text")).cast("array<float>").alias("embedding")))
    all_known = known.unionByName(fresh.select("key", F.col("embedding").alias("held")))
    own = F.when(F.size("embedding") == dim, F.col("embedding"))
    filled = chunks.withColumn("key", key).join(all_known, "key", "left").withColumn("embedding", F.coalesce(own, "held")).select(*chunks.columns)
    return filled, fresh


def content_digest(rows: DataFrame, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """One row that changes with any id or vector (to 2**-40 in each component), whatever their order: the count, and a sum of hashes."""
    said = F.concat(F.col(id).cast("string"), F.lit(":"), F.array_join(F.transform(embedding, lambda x: F.floor(x.cast("double") * (1 << 40)).cast("string")), ","))
    digest = F.sum(F.conv(F.left(F.md5(said), F.lit(15)), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    return rows.agg(F.count("*").alias("n"), digest.alias("digest"))
