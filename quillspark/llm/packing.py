"""Packing of documents into sequences of bounded length.

Packing needs lengths only, and there are at most `capacity` different ones. So the plan is made from the histogram
of lengths: first Martello and Toth's reduction fixes small sets of lengths that dominate every other choice for
their largest member, then best fit in decreasing order packs the rest. Equal bins are one bin with a count in both: a
choice that stays the same while its lengths have plenty of pieces is made for all of these at once. So the plan's size
depends on the capacity, not on the number of documents. Each piece then finds its place from its rank among the pieces
of its length.

Defined results: null text counts as empty and still has its end mark; equal rows are packed one by one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vocab
from .common import blocks, cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
#: All pieces are dealt into groups of about this many, 4096 groups at most, and ranked within length and group, so that a very
#: common length isn't one task.
RANK_GROUP = 2_000


def fit_below(present: list[int], most: int) -> int:
    """The largest of the sorted lengths that is at most `most`, or 0."""
    i = bisect_left(present, most + 1)
    return present[i - 1] if i else 0


def smallest(counts: dict[int, int], present: list[int], without: int, n: int = 3) -> list[int]:
    """The n smallest items when one of length `without` is taken away."""
    out: list[int] = []
    for x in present:
        out += [x] * min(n, counts[x] - (x == without))
        if len(out) >= n:
            break
    return out[:n]


def best_pair(counts: dict[int, int], present: list[int], room: int) -> tuple[int, int]:
    """Of pairs that fit into room: the largest sum, and the largest smaller member."""
    i, j, total, minor = 0, len(present) - 1, 0, 0
    while i <= j:
        a, b = present[i], present[j]
        if a + b > room or (i == j and counts[a] < 2):
            j -= 1
            continue
        total, minor = max(total, a + b), max(minor, a)
        i += 1
    return total, minor


#: No step below tells counts of so many from greater ones.
PLENTY = 4


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Takes from counts the bins whose content dominates every other bin with the same largest item."""
    fixed = []
    present = sorted(counts)

    def alike(items: tuple[int, ...]) -> int:
        """How many bins of these items can be taken one after another by the same decision: before each of them, all
        items' lengths still have PLENTY pieces. At least one."""
        return max(1, min((counts[x] - PLENTY) // items.count(x) for x in items))

    def take(items: tuple[int, ...], n: int) -> None:
        each = {x: items.count(x) for x in items}
        fixed.append((tuple(sorted(each.items(), reverse=True)), n))
        for x, k in each.items():
            counts[x] -= k * n
            if not counts[x]:
                del counts[x]
                present.remove(x)

    changed = True
    while changed:
        changed = False
        for j in sorted(counts, reverse=True):
            while counts.get(j):
                room = capacity - j
                low = smallest(counts, present, j)
                if not low or low[0] > room:  # nothing else fits
                    take((j,), counts[j])
                    changed = True
                    break
                rest = {**counts, j: counts[j] - 1} if j <= room else counts
                here = [x for x in present if rest[x] > 0]
                i = fit_below(here, room)
                most = counts[j] // 2 if i == j else min(counts[j], counts[i])
                if i == room or len(low) < 2 or low[0] + low[1] > room:  # fills it, or only one more fits
                    take((j, i), most)
                    changed = True
                    continue
                if len(low) == 3 and sum(low) <= room:
                    break
                total, minor = best_pair(rest, here, room)
                if i >= total:
                    take((j, i), alike((j, i)) if j <= room else most)
                    changed = True
                    continue
                b = fit_below(here, room - i)
                if b and (b != i or rest[i] > 1) and b >= minor:  # two more fit: the largest, and no pair's smaller member exceeds b
                    take((j, i, b), alike((j, i, b)))
                    changed = True
                    continue
                break
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit in decreasing order over counted items; bins of equal content are one entry with a count."""
    rooms: list[int] = []
    open_bins: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

    def add(room: int, content: tuple, n: int) -> None:
        if n:
            if room not in open_bins:
                insort(rooms, room)
                open_bins[room] = []
            open_bins[room].append((content, n))

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            k = bisect_left(rooms, x)
            if k == len(rooms):
                room, content, n = capacity, (), left
            else:
                room = rooms[k]
                content, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[k]
            each = room // x
            full = min(n, left // each)
            part = left - full * each if full < n and left // each == full else 0
            add(room - each * x, (*content, (x, each)), full)
            if part:
                add(room - part * x, (*content, (x, part)), 1)
            if content:
                add(room, content, n - full - bool(part))
            left -= full * each + part
    return [entry for entries in open_bins.values() for entry in entries]


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Slots by length and rank: rows (length, first rank, first sequence, pieces a sequence, offset), and the number
    of sequences. The pieces of a length with ranks from `first rank` on go to the sequences from `first sequence` on."""
    counts = dict(histogram)
    patterns = reduce_dominated(counts, capacity)
    patterns += best_fit(counts, capacity)
    seen: dict[int, int] = {}
    slots, sequence = [], 0
    for content, n in patterns:
        offset = 0
        for x, each in content:
            slots.append((x, seen.get(x, 0), sequence, each, offset))
            seen[x] = seen.get(x, 0) + each * n
            offset += x * each
        sequence += n
    assert seen == {x: n for x, n in histogram.items() if n}, "every piece has one slot"
    return np.array(sorted(slots), np.int64).reshape(-1, 5), sequence


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Token ids of each text as the vocabulary's own library gives them, without added special tokens."""
    fast = vocab.byte_level_encoding(path)
    allowed, out = set(fast.special_tokens_set), []
    for text in texts:
        try:
            ids = fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        except ValueError:  # its pattern engine gives up on very long runs of white space
            ids = np.array(vocab.library_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
        out.append(ids)
    return out


def pieces(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids and end mark in pieces of `capacity` ids, the first of which may be shorter."""
    path = path or vocab.default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            doc, piece, start, length, crc = [], [], [], [], []
            for d, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").fill_null("").to_pylist(), path), strict=True):
                raw = np.append(ids.astype("<u4"), np.array([end_id], "<u4"))
                n = len(raw)
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    doc.append(d)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(cut_pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces(); reads them twice, so they should come from a written table."""
    by_length = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots, _ = plan(by_length, capacity)
    groups = min(4096, max(1, sum(by_length.values()) // RANK_GROUP))
    dealt = cut_pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    before = (
        dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
        .select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    )
    ranked = dealt.withColumn("at", F.row_number().over(order).cast("long")).join(before, ["length", "part"]).withColumn("rank", F.col("at") + F.col("before") - 1)
    names = [x.split()[0] for x in PIECES.split(", ")]
    key = slots[:, 0] << 44 | slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            s = slots[np.searchsorted(key, length << 44 | rank, "right") - 1] if len(length) else slots[:0]
            k = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(s[:, 2] + k // np.maximum(s[:, 3], 1)), pa.array(s[:, 4] + k % np.maximum(s[:, 3], 1) * length)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of every document: where it was cut, a checksum of its ids, its sequence and offset there."""
    return pack(cut(pieces(docs, path, capacity, end_id, doc_id, text)), capacity)
