"""Connected components of a link table, by alternating large and small stars.

Every round replaces links by links to the least neighbour; rounds end when the table stays the same, which takes about
log2 of the longest chain. Each round's links are written to the shared folder, so lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of nodes 0 to n - 1 with links a-b: the least node of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, shorter := label[label]):
            label = shorter
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def to_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task's batches as links of each node to the least node that it reaches within the batch."""
    for batch in batches:
        u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
        if len(u):
            nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = nodes[roots(len(nodes), index[: len(u)], index[len(u) :])]
            far = root != nodes
            yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """links: u and v long, not null, in any direction. Returns (node, root) for every node that has a link to
    another node and isn't itself the root; root is the component's least node."""
    table = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").mapInArrow(to_stars, "u long, v long").distinct())
    before = None
    while True:
        now = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return table.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        table = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
