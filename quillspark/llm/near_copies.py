"""Near copies by verified Jaccard similarity of five-word shingles.

Texts with equal sets of shingles are one node. Candidates come from two sides: the SimHash operator (fingerprints of the sets, buckets
and pivot tables as in simhash) gives what differs in 4 bits or fewer, and MinHash bands give the rest, as a radius that reaches a
similarity of 0.8 (10 bits of 64 on average, up to 18) has no exact buckets: a pair with a similarity of 0.8 shares no band with a
probability of 5e-7. The families that both join are only candidates: within each, links are pairs whose sets have a Jaccard similarity of
LEAST or more, computed on the sets themselves, and what links join is a group.

Defined results: words and shingles are those of op3 at another length; a text of fewer words has one shingle, and null, empty and blank
texts have none and are copies of each other. Of each group one row stays: that with the least id (nulls last, then the least digest of its
set, then any of equal rows); an id with several texts keeps those that are first in their groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import blocks, cut, mix, small_side, tidied, utf8
from .components import components
from .simhash import majority, shingle_hashes

WORDS, LEAST, BANDS, ROWS = 5, 0.8, 48, 6
FACTORS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1) | np.uint64(1)


def shingle_sets(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in order, and where each text's begin."""
    hashes, h_at = shingle_hashes(flat, at, WORDS)
    owner = np.repeat(np.arange(len(h_at) - 1), np.diff(h_at))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[first], np.searchsorted(owner[first], np.arange(len(h_at)))


def band_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each set; starts: where the sets, none of them empty, begin."""
    out = np.zeros((len(starts), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        x = (hashes ^ FACTORS[1, k]) * FACTORS[0, k]
        least = np.minimum.reduceat(x ^ (x >> np.uint64(29)), starts)
        out[:, k // ROWS] = mix(out[:, k // ROWS] + least + np.uint64(k))
    return out


def digests(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = np.diff(at)
    some = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if len(some):
        out[some] = mix(np.add.reduceat(mix(hashes), at[:-1][some]) + n[some].astype(np.uint64))
    return out.view(np.int64)


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and text_hash as they come; digest of the set, its fingerprint and its bands."""
    for part in blocks(batches):
        hashes, at = shingle_sets(*utf8(part.column("text")))
        some = np.diff(at) > 0
        fp = majority(hashes, at)
        bands = band_keys(hashes, at[:-1][some]) if some.any() else np.zeros(0, np.uint64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * BANDS))), pa.int32()), pa.array(bands.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(digests(hashes, at)), pa.array(fp.view(np.int64)), lists], names=["doc_id", "text_hash", "digest", "fp", "bands"])


def groups_of(sets: list[np.ndarray]) -> np.ndarray:
    """A group number of each set: what links of LEAST or more join. Each set is reached once."""
    size = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(size)))
    group, has = np.full(len(sets), -1), np.zeros(int(flat.max()) + 1, bool)
    rest, tokens = np.arange(len(sets)), flat
    stack: list[int] = []
    number = -1
    while len(rest):
        open_ = group[rest] < 0
        if 2 * open_.sum() <= len(rest):  # what is reached isn't compared again
            tokens = tokens[np.repeat(open_, size[rest])]
            rest = rest[open_]
            if not len(rest):
                break
        if not stack:
            number += 1
            first = int(rest[np.flatnonzero(group[rest] < 0)[0]])
            group[first] = number
            stack.append(first)
        x = stack.pop()
        own = flat[begin[x] : begin[x + 1]]
        has[own] = True
        shared = np.add.reduceat(has[tokens].astype(np.int64), np.cumsum(size[rest]) - size[rest])
        has[own] = False
        near = rest[(group[rest] < 0) & (shared >= LEAST * (size[rest] + size[x] - shared) - 1e-9)]
        group[near] = number
        stack += near.tolist()
    return group


@tidied
def verified(rows: pa.Table) -> pa.Table:
    """digest and family, the least digest of its group, of the texts of one candidate family."""
    own: dict[int, np.ndarray] = {}
    for part in blocks(iter(rows.combine_chunks().to_batches())):
        hashes, at = shingle_sets(*utf8(part.column("text")))
        for d, a, b in zip(digests(hashes, at).tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            own.setdefault(d, hashes[a:b].copy())
    digest = np.array(list(own), np.int64)
    group = groups_of(list(own.values()))
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, digest)
    return pa.table([pa.array(digest), pa.array(least[group])], names=["digest", "family"])


def families(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest and family (the least digest of the group) of every row."""
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    marked = cut(texts.mapInArrow(sketches, "doc_id long, text_hash long, digest long, fp long, bands array<long>"))
    # copies go before anything is dealt by a band
    nodes = marked.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.min("fp").alias("fp"), F.any_value("bands").alias("bands"))
    close = simhash.families(cut(nodes.select("fp").distinct()))
    marks = nodes.select("digest", "fp").join(close, F.col("fp") == F.col("node"), "left").select("digest", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"))
    keyed = nodes.select("digest", F.explode("bands").alias("key")).unionByName(marks)
    first = keyed.groupBy("key").agg(F.min("digest").alias("other"), F.count("*").alias("n")).where("n > 1").select("key", "other")
    links = keyed.join(first, "key").where("digest <> other")
    family = components(links.select(F.col("digest").alias("u"), F.col("other").alias("v")))
    family = family.unionByName(family.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("of"), "root")
    chosen = cut(nodes.select("digest", "least").join(family, F.col("digest") == F.col("of")).select("root", F.col("least.doc_id").alias("id"), F.col("least.text_hash").alias("hash")))
    # sets are made again rather than kept: of each node one row's text travels to its family
    members = texts.join(small_side(chosen), (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")))
    found = members.select("root", "text").groupBy("root").applyInArrow(verified, "digest long, family long")
    found = found.groupBy(F.col("digest").alias("of")).agg(F.min("family").alias("family"))  # rows may be repeated
    return marked.select("doc_id", "digest").join(found, F.col("digest") == F.col("of"), "left").select("doc_id", "digest", F.coalesce("family", "digest").alias("family"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and component_id, the least doc_id of its group (its own if the group has none)."""
    rows = cut(families(docs, doc_id, text))
    least = rows.groupBy("family").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "family").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their groups."""
    rows = cut(families(docs, doc_id, text))
    first = rows.groupBy("family").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "digest")).alias("first"))
    stays = (F.col("digest") == F.col("first.digest")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    told = rows.join(first, "family").select("doc_id", "digest", stays.alias("stays"))
    by_id = cut(told.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("stays").cast("int")).alias("first")))
    ids = lambda which, name: by_id.where(which).select(F.col("doc_id").alias(name))
    gone = ids("first = 0 OR n > 1", "__gone")
    kept = docs.join(small_side(gone), docs[doc_id].cast("long").eqNullSafe(gone["__gone"]), "left_anti")
    mixed = ids("first > 0 AND n > 1", "__id")
    if mixed.isEmpty():
        return kept
    # ids with several rows, of which some stay: decided row by row
    names = docs.columns
    several = told.where("stays").select("doc_id", F.col("digest").alias("__first")).distinct().join(mixed, F.col("doc_id").eqNullSafe(F.col("__id"))).select("__id", "__first")
    own = docs.join(mixed, docs[doc_id].cast("long").eqNullSafe(F.col("__id")), "left_semi")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digests(*shingle_sets(*utf8(part.column(text)))))], names=[*names, "__digest"])

    own = own.mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField("__digest", T.LongType())]))
    own = own.join(several, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__first")))
    nth = F.row_number().over(Window.partitionBy("__id", "__digest").orderBy(text))
    return kept.unionByName(own.withColumn("__nth", nth).where("__nth = 1").select(*names))
