"""Token counts by rank-synchronous array merging.

Pre-tokens of a whole batch lie as one ragged array of symbols. In every round each sequence's lowest-rank
adjacent pair is found, and all its places in all sequences merge at once; what has no pair left is finished and
its surviving symbols are counted. Pre-tokens of over LONG characters are linked lists in the same arrays: one step for each rank, from
the lowest that is left, merges all its places in all of them and looks only at pairs that this made, so a pre-token of
a megabyte takes seconds.

Defined results: null or empty text has 0 tokens; special strings inside a text count one token each, as the
vocabulary's library does by default; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import vocab
from .common import blocks, segment_sums, utf8

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: A worker keeps the counts of so many pre-tokens of at most SHORT characters; then it forgets them all.
MEMO, SHORT = 400_000, 64
#: Characters from which a pre-token is merged as a linked list.
LONG = 512


def survivors(words: list[str], path: str) -> np.ndarray:
    """Number of symbols that each pre-token (not empty) has after all merges."""
    inner, final, keys, ranks, made, base, _, _ = vocab.word_vocabulary(path)
    flat, at = utf8(pa.array(words, pa.string()))
    symbols = inner[flat]
    symbols[at[1:] - 1] = final[flat[at[1:] - 1]]
    owner = np.repeat(np.arange(len(words)), np.diff(at))
    out = np.ones(len(words), np.int64)
    never = len(keys)
    while len(symbols):
        key = symbols[:-1] * base + symbols[1:]
        place = np.minimum(np.searchsorted(keys, key), never - 1)
        rank = np.full(len(symbols), never, np.int64)
        inside = owner[:-1] == owner[1:]
        known = inside & (keys[place] == key)
        rank[:-1][known] = ranks[place[known]]
        starts = np.flatnonzero(np.concatenate(([True], ~inside)))
        lowest = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.append(starts, len(symbols)))
        done = lowest == never
        out[owner[starts[done]]] = lengths[done]
        merge = (rank == np.repeat(lowest, lengths)) & (rank < never)
        # places that overlap (a a a): every second one of a row, from the left
        run = np.flatnonzero(merge)
        if len(run):
            fresh = np.concatenate(([True], np.diff(run) > 1))
            first = np.maximum.accumulate(np.where(fresh, run, 0))
            run = run[(run - first) % 2 == 0]
        slot = np.minimum(np.searchsorted(keys, key[run]), never - 1) if len(run) else run
        symbols[run] = made[slot]
        keep = ~np.repeat(done, lengths)
        keep[run + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    return out


def long_survivors(words: list[str], path: str) -> np.ndarray:
    """The same for long pre-tokens. Merging at one rank can't make a pair in another sequence, so the lowest rank of all sequences
    that have any is the lowest of each of those it occurs in."""
    inner, final, keys, ranks, made, base, _, _ = vocab.word_vocabulary(path)
    flat, at = utf8(pa.array(words, pa.string()))
    symbols = inner[flat]
    symbols[at[1:] - 1] = final[flat[at[1:] - 1]]
    n = len(symbols)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # neighbours of each place; n and -1 where there is none
    after[at[1:] - 1], before[at[:-1]] = n, -1
    there = np.ones(n, bool)
    by_rank = np.empty(len(keys), np.int64)
    by_rank[ranks] = np.arange(len(keys))
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def offer(places: np.ndarray) -> None:
        """Puts pairs that begin at these places in line by their ranks."""
        places = places[after[places] < n]
        key = symbols[places] * base + symbols[after[places]]
        slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        known = keys[slot] == key
        rank, places = ranks[slot[known]], places[known]
        order = np.argsort(rank, kind="stable")
        rank, places = rank[order], places[order]
        if not len(rank):
            return
        first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
        for a, b in zip(first.tolist(), np.append(first[1:], len(rank)).tolist(), strict=True):
            r = int(rank[a])
            if r not in waiting:
                waiting[r] = []
                heappush(heap, r)
            waiting[r].append(places[a:b])

    offer(np.arange(n))
    while heap:
        r = heappop(heap)
        slot = by_rank[r]
        run = np.unique(np.concatenate(waiting.pop(r)))
        run = run[there[run]]
        run = run[after[run] < n]
        run = run[symbols[run] * base + symbols[after[run]] == keys[slot]]  # others have changed since
        if not len(run):
            continue
        fresh = np.concatenate(([True], after[run[:-1]] != run[1:]))  # places that overlap, as above
        i = np.arange(len(run))
        run = run[(i - np.maximum.accumulate(np.where(fresh, i, 0))) % 2 == 0]
        gone = after[run]
        symbols[run], there[gone] = made[slot], False
        after[run] = after[gone]
        linked = run[after[run] < n]
        before[after[linked]] = linked
        left = before[run]
        offer(np.unique(np.concatenate([run, left[left >= 0]])))
    return segment_sums(there, at).astype(np.int64)


class Counter:
    """Counts tokens of texts; remembers pre-tokens between batches."""

    def __init__(self, path: str):
        self.path = path
        *_, special, self.pattern = vocab.word_vocabulary(path)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.memo: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # the library lowers letter by letter, without the final form
        return self.pattern.findall(text.lower())

    def count(self, texts: list[str]) -> np.ndarray:
        extra = np.zeros(len(texts), np.int64)
        flat: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if self.special is not None and "<|" in text and (parts := self.special.split(text)) and len(parts) > 1:
                extra[i] = len(parts) - 1
                for part in parts:
                    flat += self.words(part)
            else:
                flat += self.words(text)
            ends[i + 1] = len(flat)
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = [w for w in set(flat) if w not in self.memo]
        long = [w for w in new if len(w) > LONG]
        for k in range(0, len(long), 1 << 12):
            part = long[k : k + (1 << 12)]
            self.memo.update(zip(part, long_survivors(part, self.path).tolist(), strict=True))
        new = [w for w in new if len(w) <= LONG]
        for k in range(0, len(new), 1 << 16):
            part = new[k : k + (1 << 16)]
            self.memo.update(zip(part, survivors(part, self.path).tolist(), strict=True))
        sums = np.concatenate(([0], np.cumsum(np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat)))))
        for w in new:
            if len(w) > SHORT:
                del self.memo[w]
        for w in long:
            del self.memo[w]
        return sums[ends[1:]] - sums[ends[:-1]] + extra


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row, with the vocabulary at path."""
    path = path or vocab.default_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault(path, Counter(path))
        for part in blocks(batches):
            _, at = utf8(part.column("text"))
            n = counter.count(part.column("text").fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, SCHEMA)
