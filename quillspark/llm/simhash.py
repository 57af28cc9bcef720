"""SimHash near-duplicates with pivot distance tables.

Each text has a 64-bit fingerprint of its 4-word shingles. Equal fingerprints are one node. Fingerprints that differ
in at most 4 bits agree wholly on all but 4 of the blocks that the bits are split into, so rows meet in buckets by
those blocks. In a bucket, every fingerprint has its Hamming distances to a table of reference fingerprints (pivots);
by the triangle inequality a pair with any coordinate more than 4 apart can't be within 4 bits and is discarded; the
others are verified. A bucket gives links that join its close fingerprints, not all its pairs: a fingerprint once
reached isn't compared as a target again, so a family of near copies costs about its size. A bucket of over LARGE fingerprints is cut
by further blocks in the same way, so unrelated fingerprints that share a block aren't compared with each other either.

Pivots alone would leave all pairs of the corpus to look at (a random pivot discards less than half of them), hence
the buckets. The buckets' width follows the number of different fingerprints and changes no result.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; rows with a null id keep a
null id and have no part in component ids other than their own copies'; repeated rows are returned repeatedly; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, cut, mix, utf8
from .components import components, roots
from .ngrams import runs

SEED, WORDS, RADIUS = 42, 4, 4
#: 16 reference fingerprints from a fixed rule.
PIVOTS = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LANES = np.uint64(0x0001000100010001)


def shingle_hashes(flat: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a block's texts, and for each text where its shingles begin."""
    flat = np.where((flat >= 65) & (flat <= 90), flat + np.uint8(32), flat)
    solid = ~BLANK[flat]
    begin, end = runs(solid, at)
    n = np.diff(np.searchsorted(begin, at))
    size = end - begin
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = flat[solid]
    begin = np.cumsum(size) - size + np.arange(len(size))
    end = begin + size
    shingles = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(shingles)))
    word_at = np.concatenate(([0], np.cumsum(n)))[:-1]
    first = np.arange(out_at[-1]) + np.repeat(word_at - out_at[:-1], shingles)
    last = first + np.repeat(np.minimum(n, words) - 1, shingles)
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(begin[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first))
    return hashes, out_at


def fingerprints(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    return majority(*shingle_hashes(flat, at))


def majority(hashes: np.ndarray, h_at: np.ndarray) -> np.ndarray:
    """A bit is set if it is in over half of the text's shingle hashes."""
    n = np.diff(h_at)
    starts = np.unique(np.concatenate([h_at[:-1][n > 0], np.arange(0, len(hashes), 1 << 15)]))  # lanes hold 65535
    out = np.zeros(len(n), np.uint64)
    if not len(starts):
        return out
    owner = np.searchsorted(h_at, starts, "right") - 1
    for j in range(16):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & LANES, starts)
        for k in range(4):
            count = np.bincount(owner, (lanes >> np.uint64(16 * k)) & np.uint64(0xFFFF), minlength=len(n))
            out |= (2 * count > n).astype(np.uint64) << np.uint64(16 * k + j)
    return out


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(*utf8(part.column("text"))).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bucket_masks(n: int) -> list[int]:
    """Masks of the bits that make a bucket's key: all choices of all but RADIUS blocks, of 5, 6 or 7 blocks."""
    count = 5 if n < 1 << 21 else 6 if n < 1 << 28 else 7
    edges = [64 * i // count for i in range(count + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(block, count - RADIUS)]


def pivot_table(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int8)


def close_in_small(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of close fingerprints of equal group; all groups at once, by growing steps along the first pivot's order."""
    table = pivot_table(fp)
    order = np.lexsort((table[:, 0], group))
    group, fp_, table = group[order], fp[order], table[order]
    left, right = [], []
    live = np.arange(len(fp) - 1)
    step = 1
    while len(live):
        live = live[live + step < len(fp)]
        live = live[(group[live] == group[live + step]) & (table[live + step, 0] - table[live, 0] <= RADIUS)]
        near = live
        for a in range(1, len(PIVOTS), 5):
            near = near[(np.abs(table[near, a : a + 5] - table[near + step, a : a + 5]) <= RADIUS).all(1)]
        near = near[np.bitwise_count(fp_[near] ^ fp_[near + step]) <= RADIUS]
        left.append(order[near])
        right.append(order[near + step])
        step += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (live, live)


def close_in_large(fp: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join all fingerprints of one group which close links connect. The bits in which the group differs are cut into
    blocks of which close fingerprints have one in common, and rows meet within these: unrelated ones part, as in the buckets."""
    free = [b for b in range(64) if int(np.bitwise_or.reduce(fp ^ fp[0])) >> b & 1]
    if len(free) <= RADIUS:
        return np.zeros(len(fp) - 1, np.int64), np.arange(1, len(fp))
    left, right = [], []
    for k in range(RADIUS + 1):
        own = free[len(free) * k // (RADIUS + 1) : len(free) * (k + 1) // (RADIUS + 1)]
        key = fp & np.uint64(sum(1 << b for b in own))
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        size = np.diff(np.append(first, len(key)))
        small = order[np.repeat((size > 1) & (size <= LARGE), size)]
        a, b = close_in_small(key[small], fp[small])
        left.append(small[a])
        right.append(small[b])
        for j in np.flatnonzero(size > LARGE).tolist():
            part = order[first[j] : first[j] + size[j]]
            a, b = reach(fp[part]) if depth == DEPTH or 2 * len(part) > len(fp) else close_in_large(fp[part], depth + 1)
            left.append(part[a])
            right.append(part[b])
    return np.concatenate(left), np.concatenate(right)


def reach(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for a group that is close together: each is reached once."""
    table = pivot_table(fp)
    left, right = [], []
    rest = np.argsort(table[:, 0], kind="stable")  # not yet reached, in the first pivot's order
    stack: list[int] = []
    gone = np.zeros(len(fp), bool)
    lost = 0
    while len(rest) or stack:
        if not stack:
            rest, lost = rest[~gone[rest]], 0
            if not len(rest):
                break
            stack.append(int(rest[0]))
            gone[rest[0]] = True
        x = stack.pop()
        if lost * 2 > len(rest):
            rest, lost = rest[~gone[rest]], 0
        low, high = np.searchsorted(table[rest, 0], [table[x, 0] - RADIUS, table[x, 0] + RADIUS + 1])
        near = rest[low:high]
        near = near[~gone[near]]
        near = near[(np.abs(table[near] - table[x]) <= RADIUS).all(1)]
        near = near[np.bitwise_count(fp[near] ^ fp[x]) <= RADIUS]
        gone[near] = True
        lost += len(near)
        stack += near.tolist()
        left.append(np.full(len(near), x))
        right.append(near)
    return (np.concatenate(left), np.concatenate(right)) if left else (rest, rest)


#: Groups that are searched at once, and how often larger ones are cut.
LARGE, DEPTH = 256, 3


def links_of(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least fingerprint reached) within the groups of equal key; rows are sorted by key."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    group = np.repeat(np.arange(len(first)), size)
    small = np.flatnonzero(((size > 1) & (size <= LARGE))[group])
    a, b = close_in_small(group[small], fp[small])
    left, right = [small[a]], [small[b]]
    for k in np.flatnonzero(size > LARGE):
        a, b = close_in_large(fp[first[k] : first[k] + size[k]])
        left.append(a + first[k])
        right.append(b + first[k])
    nodes, index = np.unique(fp.view(np.int64), return_inverse=True)
    root = roots(len(nodes), index[np.concatenate(left)], index[np.concatenate(right)])
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by key: links within each key. A key's rows may lie in several batches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def links(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if parts:
            u, v = links_of(np.concatenate([k for k, _ in parts]), np.concatenate([x for _, x in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        if not len(key):
            continue
        done = int(np.searchsorted(key, key[-1]))
        if done or (held and held[-1][0][-1] != key[0]):
            yield from links([*held, (key[:done], fp[:done])] if done else held)
            held = []
        held.append((key[done:], fp[done:]))
    yield from links(held)


def families(nodes: DataFrame) -> DataFrame:
    """nodes: different fingerprints fp. Returns (node, root) of those that links of RADIUS bits or fewer join to another one."""
    masks = bucket_masks(nodes.count())
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)))) for i, m in enumerate(masks)])
    buckets = nodes.select("fp", F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key")
    return components(buckets.mapInArrow(bucket_links, "u long, v long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links of RADIUS bits or fewer)."""
    marked = cut(fingerprint(docs, doc_id, text))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = families(nodes)
    joined = cut(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    of_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = joined.join(of_root, "root").select(F.col("fp").alias("of"), "component_id")
    return marked.join(by_fp, marked["fp"] == by_fp["of"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
