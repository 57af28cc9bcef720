"""Approximate vector search over cells, with a measured recall and an exact way.

Cells are spherical k-means centres fitted on a bounded sample; every row is dealt to its nearest one. A query looks into the cells whose centres
are nearest to it. How many these have to be is measured: for some rows as queries, the true neighbours among all rows come from one exact
pass, and the place of each neighbour's cell in the query's order tells what any number of cells would find; the least number with a recall
of `target` is kept. All cells together are the exact search, which small tables get.

Rows of a cell are dealt into parts of about PART rows, and each part meets the queries that look into its cell, so neither a large cell nor a
popular one is a task by itself. A part gives each query its k best rows; these few are ranked.

Defined results: rows and queries whose vector is null, of another size, zero, or not finite have no neighbours; ties go by id; a row finds
itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that centres are fitted on, in expectation; rounds of fitting; cells at most, and rows under which all is compared.
SAMPLE, ROUNDS, CELLS, SMALL = 1 << 14, 12, 1024, 1 << 10
#: Queries that recall is measured with, in expectation; rows of a part; queries that are compared at once.
AUDIT, PART, BLOCK = 200, 1 << 16, 512
FOUND = "query_id {0}, id {0}, score double"


@dataclass
class Cells:
    centres: np.ndarray  # cells x dim, of length 1
    probes: int  # cells that a query looks into
    recall: float  # measured with these


def unit_rows(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can be compared, and these with length 1."""
    x = np.zeros((len(column), dim))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == dim and None not in v:
            x[i] = v
    size = np.abs(x).max(1, initial=0)
    good = np.flatnonzero(np.isfinite(size) & (size > 0))
    x = x[good] / size[good, None]
    return good, x / np.sqrt((x * x).sum(1, keepdims=True))


def share_of(rows: DataFrame, id: str, n: int, wanted: int, salt: str) -> DataFrame:
    """About `wanted` of n rows, the same ones on every run."""
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), id), F.lit(1 << 30)) < int(min(1.0, wanted / max(1, n)) * (1 << 30)))


def centres_of(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = (x @ out.T).argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(1))
        out = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], out)
    return out


def fit(rows: DataFrame, dim: int, k: int = 10, id: str = "id", embedding: str = "embedding", target: float = 0.95, seed: int = 3) -> Cells:
    """Centres and the number of cells to look into for k neighbours."""
    known = rows.where(F.size(embedding) == dim).select(id, embedding)
    n = known.count()
    _, x = unit_rows(share_of(known, id, n, SAMPLE, "centres").toArrow().column(embedding), dim)
    if n < SMALL or len(x) < 2:
        return Cells(np.ones((1, dim)) / np.sqrt(dim), 1, 1.0)
    cells = Cells(centres_of(x, min(CELLS, int(np.sqrt(n))), seed), 0, 0.0)
    cells.probes = len(cells.centres)
    asked = share_of(known, id, n, AUDIT, "audit")
    true = search(index(known, cells, id, embedding), asked, cells, k, id, embedding)
    of = index(known, cells, id, embedding).select(F.col(id).alias("id"), "cell")
    held = true.join(of, "id").join(asked.select(F.col(id).alias("query_id"), F.col(embedding).alias("asked")), "query_id").select("query_id", "cell", "asked").toArrow()
    good, q = unit_rows(held.column("asked"), dim)
    order = np.argsort(np.argsort(-(q @ cells.centres.T), axis=1, kind="stable"), axis=1)
    place = order[np.arange(len(good)), held.column("cell").to_numpy()[good]]
    for probes in range(1, len(cells.centres) + 1):
        cells.probes, cells.recall = probes, float((place < probes).mean()) if len(place) else 1.0
        if cells.recall >= target:
            break
    return cells


def index(rows: DataFrame, cells: Cells, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """id, embedding and cell of all rows that can be compared. Written by cell, a query opens its cells only."""
    kind, dim = rows.schema[id].dataType, cells.centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = unit_rows(batch.column(embedding), dim)
            cell = (x @ cells.centres.T).argmax(1) if len(good) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(id).take(pa.array(good)), batch.column(embedding).take(pa.array(good)), pa.array(cell.astype(np.int32))], names=[id, embedding, "cell"])

    return rows.select(id, embedding).mapInArrow(run, T.StructType([T.StructField(id, kind), rows.schema[embedding], T.StructField("cell", T.IntegerType())]))


def search(indexed: DataFrame, queries: DataFrame, cells: Cells, k: int, id: str = "id", embedding: str = "embedding", probes: int | None = None) -> DataFrame:
    """query_id, id, score, rank of the k best rows in the nearest cells of each query (id, embedding). probes: how many; all are exact."""
    kind, dim = indexed.schema[id].dataType, cells.centres.shape[1]
    probes = min(len(cells.centres), probes or cells.probes)
    sizes = indexed.groupBy("cell").agg(F.count("*").alias("n"))  # a row for each cell
    parts = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    dealt = indexed.join(parts, "cell").select("cell", F.pmod(F.xxhash64(id), F.col("parts")).cast("int").alias("part"), F.col(id).alias("id"), F.col(embedding).alias("v"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = unit_rows(batch.column(embedding), dim)
            near = np.argsort(-(x @ cells.centres.T), axis=1, kind="stable")[:, :probes]
            row = pa.array(np.repeat(good, probes))
            yield pa.RecordBatch.from_arrays([batch.column(id).take(row), batch.column(embedding).take(row), pa.array(near.ravel().astype(np.int32))], names=["query_id", "q", "cell"])

    asked = queries.select(id, embedding).mapInArrow(probe, T.StructType([T.StructField("query_id", kind), T.StructField("q", indexed.schema[embedding].dataType), T.StructField("cell", T.IntegerType())]))
    asked = asked.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "q")

    def best(key: tuple, rows: pa.Table, of: pa.Table) -> pa.Table:
        _, x = unit_rows(rows.column("v"), dim)
        _, q = unit_rows(of.column("q"), dim)
        ids = rows.column("id").combine_chunks()
        by_id = np.argsort(np.array(ids.to_pylist(), object), kind="stable")  # ties in order of ids
        x, n = x[by_id], min(k, len(ids))
        left, right, score = [], [], []
        for a in range(0, len(q) if n else 0, BLOCK):
            sims = q[a : a + BLOCK] @ x.T
            cut = -np.partition(-sims, n - 1, axis=1)[:, n - 1 : n]
            i, j = np.nonzero(sims >= cut)
            order = np.lexsort((j, -sims[i, j], i))
            i, j = i[order], j[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[nth < n], j[nth < n]
            left.append(i + a)
            right.append(by_id[j])
            score.append(sims[i, j])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table([of.column("query_id").combine_chunks().take(pa.array(join(left, np.int64))), ids.take(pa.array(join(right, np.int64))), pa.array(join(score, np.float64))], names=["query_id", "id", "score"])

    found = dealt.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(best, FOUND.format(kind.simpleString()))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def measured(approximate: DataFrame, exact: DataFrame) -> float:
    """Share of the exact pairs (query_id, id) that an approximate result has."""
    n, hit = exact.select("query_id", "id").join(approximate.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left").agg(F.count("*"), F.count("hit")).first()
    return hit / n if n else 1.0
