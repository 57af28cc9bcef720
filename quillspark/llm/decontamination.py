"""Benchmark decontamination with spaced-seed hashing.

A seed is a fixed mask over token positions: the tokens it keeps are hashed, those it skips may differ. Seeds of the
test items are looked up at every place of the training texts, and around every hit the two token rows are laid side by
side: an item is found in a text when, on some alignment, at least 80 % of some window of consecutive tokens agree (of all
tokens, for shorter items). The two masks together hit every window of 13: with up to 2 differing tokens, one of
them lies wholly on equal tokens somewhere in it.

Tokens are words of letters, marks and digits, in lower case; in scripts that don't part words by blanks (Chinese, Japanese, Thai, Lao,
Tibetan, Burmese, Khmer) each character is a token. A window has 13 tokens, or 26 in items that are mostly such characters, as one of these
says about half of what a word says. Items of fewer than 5 words or 10 such characters (a word weighs as much as two) are too common
to be evidence within a text: they match texts that consist of the same tokens and nothing else. Items without a token match nothing.

Defined results: null and empty texts match nothing; each row of the documents gets a row for each different test item (id and text)
that it contains, so repeated documents give repeated rows, and an id with two texts can give two; repeated items count once; null ids
stay null; other columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, utf8
from .ngrams import characters, runs, slice_hashes

#: Tokens of a window, of a window of single characters; weight under which an item matches whole texts only.
WINDOW, WIDE, SHARE, LIGHT = 13, 26, 0.8, 10
#: Two masks of weight 6 that together leave no way to place 2 differences among 13 tokens unseen.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
#: Blocks of scripts without blanks between words; from 0x20000 on there are ideographs only.
UNSPACED = ((0x0E00, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F))
#: A slice of the test items that one pass over the training texts takes along, in bytes of text. Larger sets of items take several passes.
SLICE_BYTES = 16 << 20
#: Seed hits that are looked at together.
HITS = 1 << 15
SCHEMA = "doc_id long, item_id long, n_match int, n_item int, similarity double"
BLOOM = 22


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point under 0x20000: its lower-case form, and 0 for what parts tokens, 1 for parts of words, 2 for single tokens."""
    lower, kind = np.arange(0x20000, dtype=np.uint32), np.zeros(0x20000, np.int8)
    for c in range(0x20000):
        if unicodedata.category(chr(c))[0] in "LMN":
            kind[c] = 1
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
    for a, b in UNSPACED:
        kind[a : b + 1] *= 2
    return lower, kind


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, for each text where its tokens begin, and which tokens are single characters."""
    code, at = characters(*utf8(column))
    lower, kind = letters()
    far = code >= len(lower)
    near = np.where(far, 0, code)
    kinds = np.where(far, np.int8(2), kind[near])
    code = np.where(far, code, lower[near])
    begin, end = runs(kinds == 1, at)
    alone = np.flatnonzero(kinds == 2)
    if len(alone):
        begin, end = np.concatenate([begin, alone]), np.concatenate([end, alone + 1])
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
    return slice_hashes(code, begin, end), np.searchsorted(begin, at), kinds[begin] == 2


def needed(width: int) -> int:
    return ceil(SHARE * width - 1e-9)


def masks_for(n: int, window: int = WINDOW) -> tuple[tuple[int, ...], ...]:
    """Masks for items of n tokens. Half of a wide window has at most half of its differences. Items shorter than the window: with k
    differences allowed, one of k + 1 parts is equal."""
    if n >= window:
        return MASKS
    parts = n - needed(n) + 1
    edges = [n * i // parts for i in range(parts + 1)]
    return tuple(tuple(range(b - a)) for a, b in zip(edges, edges[1:], strict=False))


def seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed that begins at each token, without regard to where texts end."""
    n = len(hashes) - mask[-1]
    out = np.zeros(max(n, 0), np.uint64)
    for k, o in enumerate(mask):
        out += (hashes[o : o + n] if n > 0 else hashes[:0]) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) % (1 << 64))
    return mix(out) if n > 0 else out


class Items:
    """Test items with their seeds by mask."""

    def __init__(self, texts: list[str]):
        self.hashes, self.at, single = tokens(pa.array(texts, pa.string()))
        self.size = np.diff(self.at)
        singles = np.diff(np.concatenate(([0], np.cumsum(single)))[self.at])
        light = 2 * self.size - singles < LIGHT
        window = np.where(2 * singles > self.size, WIDE, WINDOW)
        self.width = np.minimum(self.size, window)
        self.whole: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(light & (self.size > 0)).tolist():
            self.whole.setdefault(self.hashes[self.at[i] : self.at[i + 1]].tobytes(), []).append(i)
        self.longest = int(self.size[light].max(initial=0))
        by_mask: dict[tuple[int, ...], np.ndarray] = {}
        for n, w in sorted({(min(n, WIDE), w) for n, w in zip(self.size[~light].tolist(), window[~light].tolist(), strict=True)}):
            own = ~light & (np.minimum(self.size, WIDE) == n) & (window == w)
            for mask in masks_for(n, w):
                by_mask[mask] = by_mask.get(mask, False) | own
        item_of = np.repeat(np.arange(len(texts)), self.size)
        self.seeds = []
        for mask, members in sorted(by_mask.items()):
            own = seeds(self.hashes, mask)
            place = np.flatnonzero(members[item_of[: len(own)]] & (item_of[: len(own)] == item_of[mask[-1] :]))
            s, item = own[place], item_of[place]
            order = np.argsort(s, kind="stable")
            bloom = np.zeros(1 << BLOOM, bool)
            bloom[s >> np.uint64(64 - BLOOM)] = True
            self.seeds.append((mask, s[order], item[order], (place - self.at[item])[order], bloom))

    def found(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct rows (text, item, diagonal) of alignments on which the item is found in the text."""
        text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        out = [np.zeros((0, 3), np.int64)]
        for mask, s, item, place, bloom in self.seeds:
            own = seeds(hashes, mask)
            where = np.flatnonzero(bloom[own >> np.uint64(64 - BLOOM)])
            where = where[text_of[where] == text_of[where + mask[-1]]]
            first = np.searchsorted(s, own[where], "left")
            upto = np.cumsum(np.searchsorted(s, own[where], "right") - first)
            for low in range(0, int(upto[-1]) if len(upto) else 0, HITS):
                hit = np.arange(low, min(low + HITS, int(upto[-1])))
                k = np.searchsorted(upto, hit, "right")
                row = first[k] + hit - np.concatenate(([0], upto))[k]
                good = self.holds(hashes, at, where[k], text_of[where[k]], item[row], place[row], mask[-1] + 1)
                p, t, i, q = where[k][good], text_of[where[k][good]], item[row[good]], place[row[good]]
                out.append(np.unique(np.stack([t, i, p - at[t] - q], 1), axis=0))
        if self.whole:
            size = np.diff(at)
            for t in np.flatnonzero((size > 0) & (size <= self.longest)).tolist():
                same = self.whole.get(hashes[at[t] : at[t + 1]].tobytes(), [])
                out.append(np.array([(t, i, 0) for i in same], np.int64).reshape(-1, 3))
        return np.unique(np.concatenate(out), axis=0)

    def holds(self, hashes: np.ndarray, at: np.ndarray, p: np.ndarray, t: np.ndarray, i: np.ndarray, q: np.ndarray, span: int) -> np.ndarray:
        """For hits of a seed of `span` tokens at place p of the texts t and place q of the items i: whether enough tokens agree in a window
        around it that lies in both."""
        out = np.zeros(len(p), bool)
        for w in np.unique(self.width[i]).tolist():
            own = np.flatnonzero(self.width[i] == w)
            o = np.arange(span - w, w)
            here, there = p[own, None] + o, q[own, None] + o
            inside = (here >= at[t[own], None]) & (here < at[t[own] + 1, None]) & (there >= 0) & (there < self.size[i[own], None])
            equal = hashes[np.where(inside, here, 0)] == self.hashes[np.where(inside, there + self.at[i[own], None], 0)]
            sums = np.zeros((len(own), len(o) + 1), np.int32)
            np.cumsum(np.where(inside, equal, -w), axis=1, out=sums[:, 1:])
            out[own] = (sums[:, w:] - sums[:, :-w]).max(1) >= needed(w)
        return out

    def best(self, hashes: np.ndarray, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of found(): texts, items, and the number of tokens that agree on the best of their alignments."""
        t, i, diagonal = found.T
        low, high = np.maximum(0, -diagonal), np.minimum(self.size[i], np.diff(at)[t] - diagonal)
        n, same = high - low, np.zeros(len(t), np.int64)
        upto = np.cumsum(n)
        begin = 0
        while begin < len(t):  # some alignments at a time
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] - n[begin] + 16 * HITS, "right")))
            own = slice(begin, end)
            k = np.repeat(np.arange(begin, end), n[own])
            o = np.arange(len(k)) - np.repeat(np.cumsum(n[own]) - n[own], n[own]) + low[k]
            equal = hashes[at[t[k]] + diagonal[k] + o] == self.hashes[self.at[i[k]] + o]
            same[own] = np.bincount(k - begin, equal, end - begin)
            begin = end
        fresh = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (i[1:] != i[:-1])))) if len(t) else t
        return t[fresh], i[fresh], np.maximum.reduceat(same, fresh) if len(t) else same


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of docs and test item that it contains: the tokens that agree on the best alignment, and the item's."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    out = None
    for items in item_slices(benchmark, item_id, item_text):
        found = one_pass(rows, items)
        out = found if out is None else out.unionByName(found)
    return out


def item_slices(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> Iterator[list[tuple[int | None, str]]]:
    """The different test items in slices of about SLICE_BYTES; at least one slice."""
    items = benchmark.select(benchmark[item_id].cast("long").alias("item_id"), benchmark[item_text].cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    passes = max(1, ceil(total / SLICE_BYTES))
    for k in range(passes):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
        yield sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def one_pass(rows: DataFrame, items: list[tuple[int | None, str]]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(([i for i, _ in items], [t for _, t in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, table = pa.array(held.value[0], pa.int64()), Items(held.value[1])
        for part in blocks(batches):
            hashes, at, _ = tokens(part.column("text"))
            t, i, same = table.best(hashes, at, table.found(hashes, at))
            if len(t):
                n = table.size[i]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(t)), ids.take(pa.array(i)), pa.array(same.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(same / n)], names=["doc_id", "item_id", "n_match", "n_item", "similarity"])

    return rows.mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that contain no test item."""
    for items in item_slices(benchmark):
        docs = docs.mapInArrow(keep_clean(docs, [t for _, t in items], text), docs.schema)
    return docs


def keep_clean(docs: DataFrame, items: list[str], text: str):
    held = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Items(held.value)
        for part in blocks(batches, text):
            hashes, at, _ = tokens(part.column(text))
            keep = np.ones(part.num_rows, bool)
            keep[table.found(hashes, at)[:, 0]] = False
            yield part.filter(pa.array(keep))

    return run
