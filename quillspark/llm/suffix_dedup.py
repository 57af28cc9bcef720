"""Removal of repeated byte strings with sharded suffix arrays.

Every byte that a string of `length` bytes covers goes if that string also starts in a document with a smaller id.

1. Documents are dealt into units by a hash of the id. Each window of `length` bytes has a minimizer: the least hash of the
   32-byte strings in it. Equal windows have equal minimizers, so a window can only repeat if its minimizer occurs in
   two documents; units send the different minimizers they have, and learn which those are.
2. Such windows are dealt out by a second minimizer, over 16-byte strings, which changes less often along a text: windows
   in a row that share it make one string. Each unit sends its different strings, with the least id of a document that
   holds them, to a shard given by that minimizer. So equal windows meet in one shard, whatever unit or place they come
   from, and a passage in many documents is one string per unit.
   A minimizer that very many units have (HOT_UNITS) would bring a string from each to one shard. Units learn that with their marks, and
   deal its windows out one by one, by a hash of all their bytes. Short minimizers are common at any size (a phrase of 16 bytes), so with
   every SALT_BYTES of input each of them is dealt out to one shard more, by the long minimizer beside it.
3. A shard sorts the suffixes of its strings (see suffix_sort), finds neighbours with common prefixes of `length` bytes, and
   tells for every window the least id of a document that has it. Units remove what others have first.

Texts are shuffled once; the three places that need them read the same exchange.

Defined results: null text counts as empty; documents with equal ids don't repeat each other; a null id counts as greater than
all others; equal rows keep their bytes unless a smaller id has them; texts shorter than `length` bytes stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, mix, tidied, utf8
from .ngrams import slice_hashes
from .suffix_sort import permuted_prefixes, suffix_array

LENGTH, GRAM, SHORT = 50, 32, 16
#: Bytes of text in a unit; minimizers in a bucket (about a tenth of the bytes are minimizers).
UNIT_BYTES, BUCKET_SIZE = 6 << 20, 1 << 20
#: Units that a minimizer may occur in before its windows are dealt out singly; bytes of input for each shard of a short minimizer.
HOT_UNITS, SALT_BYTES = 1024, 1 << 36
WHOLE = (1 << 63) - 1


def sliding_least(low: np.ndarray, span: int) -> np.ndarray:
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[: len(low) - span + width], low[span - width :]) if span > width else low


def window_minimizers(flat: np.ndarray, length: int, short: bool = False) -> np.ndarray:
    """The least hash of the 32-byte (short: 16-byte) strings in each window of `length` bytes, by the window's first byte."""
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    words = np.ndarray(shape=(len(flat),), dtype="<u8", buffer=padded, strides=(1,))
    h = words * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    n = len(flat) - SHORT + 1
    two = h[:n] * np.uint64(0x94D049BB133111EB) + (h[8 : n + 8] ^ (h[8 : n + 8] >> np.uint64(31)))
    if short:
        return sliding_least(mix(two), length - SHORT + 1)
    n = len(flat) - GRAM + 1
    return sliding_least(mix(two[:n] * np.uint64(0xD6E8FEB86659FD93) + two[16 : n + 16]), length - GRAM + 1)


def minimizer_runs(column: pa.Array, length: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes and begins; of each run of windows with one minimizer: the minimizer cut to `bits` bits, the
    document's index, the first byte and the number of windows."""
    flat, at = utf8(column)
    value, doc, start, count = [], [], [], []
    rows = pa.RecordBatch.from_arrays([column], names=["text"])
    base = 0
    for part in blocks(iter([rows]), size=1 << 19):
        own, own_at = utf8(part.column("text"))
        if len(own) >= length:
            low = window_minimizers(own, length) >> np.uint64(64 - bits)
            index = np.repeat(np.arange(part.num_rows), np.diff(own_at))[: len(low)]
            good = np.arange(len(low)) + length <= own_at[1:][index]
            where = np.flatnonzero(good)
            if len(where):
                low, index = low[where], index[where]
                first = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (index[1:] != index[:-1]))))
                value.append(low[first])
                doc.append(index[first] + base)
                start.append(where[first] + at[base])
                count.append(np.diff(np.append(first, len(low))))
        base += part.num_rows
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return flat, at, join(value, np.uint64), join(doc, np.int64), join(start, np.int64), join(count, np.int64)


def distinct_minimizers(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values in order; whether two documents have them; for each given value its place."""
    order = np.argsort(value, kind="stable")
    v, d = value[order], doc[order]
    fresh = np.concatenate(([True], v[1:] != v[:-1])) if len(v) else np.zeros(0, bool)
    place = np.empty(len(v), np.int64)
    place[order] = np.cumsum(fresh) - 1
    shared = np.zeros(int(fresh.sum()), bool)
    if len(v):
        shared[place[order][1:][~fresh[1:] & (d[1:] != d[:-1])]] = True
    return v[fresh], shared, place


class Plan:
    """What all steps agree on."""

    def __init__(self, total_bytes: int, length: int):
        self.length = length
        self.units = max(1, -(-total_bytes // UNIT_BYTES))
        # buckets grow with the input, so that a bucket holds about BUCKET_SIZE minimizers at every size
        self.bucket_bits = max(2, (total_bytes // (10 * BUCKET_SIZE)).bit_length())
        # 32 bits of a minimizer beside its bucket tell about BUCKET_SIZE of them apart well enough; past 2**16 buckets all 64 bits are used
        self.wide = self.bucket_bits > 16
        self.bits = 64 if self.wide else self.bucket_bits + 32
        self.shards = 4 * self.units
        self.hot, self.salts = HOT_UNITS, 1 + total_bytes // SALT_BYTES

    def shard(self, value: np.ndarray) -> np.ndarray:
        return (mix(value + np.uint64(0x632BE59BD9B4E019)) % np.uint64(self.shards)).astype(np.int64)


class Unit:
    """One unit's documents in order of their ids (and texts, so that each step finds the same order), with their minimizers."""

    def __init__(self, rows: pa.Table, plan: Plan):
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))  # nulls are last
        self.rows, self.plan = rows, plan
        self.ids = pc.fill_null(rows.column("doc_id").combine_chunks(), WHOLE).to_numpy()
        column = rows.column("text").combine_chunks().cast(pa.large_string()).fill_null("")
        self.flat, self.at, self.value, self.doc, self.start, self.count = minimizer_runs(column, plan.length, plan.bits)
        self.distinct, self.shared, self.place = distinct_minimizers(self.value, self.ids[self.doc] if len(self.doc) else self.doc)

    def strings(self, repeated: np.ndarray, hot: np.ndarray) -> None:
        """For each of the distinct minimizers: whether two documents of any unit have it, and whether very many units do. Sets `texts`, the
        different strings by shard and then by first place, their shards, their least ids and windows; of the places where they stand:
        `begin`, `n` windows, `at_doc`, and `of`, the string."""
        none = np.zeros(0, np.int64)
        runs = self.shard_runs(np.flatnonzero((repeated & ~hot)[self.place]) if len(self.place) else none)
        single = self.single_windows(np.flatnonzero(hot[self.place]) if len(self.place) else none)
        self.singles = len(single[0])
        value, doc, begin, n = (np.concatenate(x) for x in zip(runs, single, strict=True)) if self.singles else runs
        data, table = self.flat.tobytes(), {}
        end = begin + n + self.plan.length - 1
        of = np.fromiter((table.setdefault(data[a:b], len(table)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.int64, len(begin))
        # the least id comes from the first place in the order of documents, which single windows are out of
        least = np.full(len(table), WHOLE)
        np.minimum.at(least, of, self.ids[doc])
        own = np.full(len(table), len(of))
        np.minimum.at(own, of, np.arange(len(of)))
        shard = self.plan.shard(value[own])
        order = np.argsort(shard, kind="stable")
        texts = list(table)
        self.texts, self.shard = [texts[i] for i in order.tolist()], shard[order]
        self.least, self.windows = least[order], n[own][order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.begin, self.n, self.at_doc, self.of = begin, n, doc, rank[of]

    def single_windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows in the given runs, each by itself: a hash of its bytes, its document, first byte and 1."""
        n = self.count[runs]
        begin = np.repeat(self.start[runs], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        value = slice_hashes(self.flat, begin, begin + self.plan.length) if len(begin) else np.zeros(0, np.uint64)
        return value, np.repeat(self.doc[runs], n), begin, np.ones(len(begin), np.int64)

    def shard_runs(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of windows in the given runs, joined where they touch: runs of windows with one short minimizer (and one salt). Their keys,
        documents, first bytes and numbers of windows."""
        begin, n, doc = self.start[runs], self.count[runs], self.doc[runs]
        apart = np.concatenate(([True], (begin[1:] != begin[:-1] + n[:-1]) | (doc[1:] != doc[:-1]))) if len(runs) else np.zeros(0, bool)
        first = np.flatnonzero(apart)
        total = np.add.reduceat(n, first) if len(first) else first
        if self.plan.salts > 1:
            salts = np.repeat(mix(self.value[runs] + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.plan.salts), n)
            salt_at = np.concatenate(([0], np.cumsum(total)))
        begin, doc = begin[first], doc[first]
        out: list[list[np.ndarray]] = [[], [], [], []]
        size = total + self.plan.length - 1
        k = 0
        while k < len(begin):  # some stretches at a time, side by side
            stop = max(k + 1, int(np.searchsorted(np.cumsum(size[k:]), 1 << 19)) + k)
            own, at = size[k:stop], np.concatenate(([0], np.cumsum(size[k:stop])))
            place = np.arange(at[-1]) + np.repeat(begin[k:stop] - at[:-1], own)
            low = window_minimizers(self.flat[place], self.plan.length, short=True)
            stretch = np.repeat(np.arange(stop - k), own)[: len(low)]
            where = np.flatnonzero(np.arange(len(low)) + self.plan.length <= at[1:][stretch])
            low, stretch = low[where], stretch[where]
            if self.plan.salts > 1:
                low = mix(low + salts[salt_at[k] : salt_at[stop]])
            head = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (stretch[1:] != stretch[:-1]))))
            for x, y in zip(out, (low[head], doc[k:stop][stretch[head]], place[where[head]], np.diff(np.append(head, len(low)))), strict=True):
                x.append(y)
            k = stop
        return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, (np.uint64, np.int64, np.int64, np.int64), strict=True))

    def removed(self, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """owner: the least id that has a window, for all windows of all strings in order. The maximal runs of bytes that go, in
        order: document, begin, end."""
        first = np.concatenate(([0], np.cumsum(self.windows)))
        inside = np.arange(int(self.n.sum())) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        doc = np.repeat(self.at_doc, self.n)
        hit = np.flatnonzero(owner[np.repeat(first[self.of], self.n) + inside] < self.ids[doc])
        start = (np.repeat(self.begin, self.n) + inside)[hit]
        doc = doc[hit]
        if self.singles:  # which come after all others
            order = np.argsort(start, kind="stable")
            start, doc = start[order], doc[order]
        if not len(start):
            return doc, start, start
        cut_at = np.flatnonzero((start[1:] > start[:-1] + self.plan.length) | (doc[1:] != doc[:-1]))
        head, tail = np.concatenate(([0], cut_at + 1)), np.append(cut_at, len(start) - 1)
        return doc[head], start[head], start[tail] + self.plan.length


def grouped(table: pa.Table) -> dict[str, np.ndarray | list]:
    return {name: table.column(name).to_pylist() for name in table.column_names}


MESSAGE = "unit long, kind int, at long, lens binary, data binary"


def message(unit: list, kind: int, at: list, lens: list, data: list) -> pa.Table:
    return pa.table([pa.array(unit, pa.int64()), pa.array([kind] * len(unit), pa.int32()), pa.array(at, pa.int64()), pa.array(lens, pa.binary()), pa.array(data, pa.binary())], names=["unit", "kind", "at", "lens", "data"])


def send_minimizers(plan: Plan) -> Callable[[tuple, pa.Table], pa.Table]:
    kind = np.uint64 if plan.wide else np.uint32

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        unit = Unit(rows, plan)
        low = np.uint64(plan.bits - plan.bucket_bits)
        bucket = (unit.distinct >> low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else bucket
        edges = np.append(first, len(bucket))
        rest = (unit.distinct & ((np.uint64(1) << low) - np.uint64(1))).astype(kind)
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return pa.table([pa.array(bucket[first]), pa.array([key[0].as_py()] * len(first), pa.int64()), pa.array([rest[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([np.packbits(unit.shared[a:b]).tobytes() for a, b in spans], pa.binary())], names=["bucket", "unit", "data", "shared"])

    return run


def mark_repeated(plan: Plan) -> Callable[[tuple, pa.Table], pa.Table]:
    """Of a bucket: tells each unit which of its minimizers occur in two documents, and which in very many units."""
    kind = np.uint64 if plan.wide else np.uint32

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        got = grouped(rows)
        values = [np.frombuffer(x, kind) for x in got["data"]]
        sizes = [len(v) for v in values]
        v = np.concatenate(values)
        marked = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(got["shared"], sizes, strict=True)]).astype(bool)
        order = np.argsort(v, kind="stable")
        fresh = np.concatenate(([True], v[order][1:] != v[order][:-1]))
        group = np.cumsum(fresh) - 1
        units = np.bincount(group)
        many = (units > 1) | (np.bincount(group, marked[order]) > 0)
        out, hot = np.empty(len(v), bool), np.empty(len(v), bool)
        out[order], hot[order] = many[group], (units > plan.hot)[group]
        at = np.concatenate(([0], np.cumsum(sizes)))
        return message(got["unit"], 0, [key[0].as_py()] * len(sizes), [np.array([n], "<i8").tobytes() for n in sizes], [np.packbits(out[a:b]).tobytes() + np.packbits(hot[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)])

    return run


def marks_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The unit's marks for its distinct minimizers (repeated, and hot), from messages of kind 0."""
    got = grouped(rows)
    parts = []
    for kind, k, n, d in zip(got["kind"], got["at"], got["lens"], got["data"], strict=True):
        if kind == 0:
            bits, n = np.frombuffer(d, np.uint8), int(np.frombuffer(n, "<i8")[0])
            parts.append((k, np.unpackbits(bits[: len(bits) // 2], count=n), np.unpackbits(bits[len(bits) // 2 :], count=n)))
    parts.sort(key=lambda x: x[0])
    return tuple(np.concatenate([p[i] for p in parts]).astype(bool) if parts else np.zeros(0, bool) for i in (1, 2))


def send_strings(plan: Plan) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table, marks: pa.Table) -> pa.Table:
        unit = Unit(rows, plan)
        unit.strings(*marks_of(marks))
        shard = unit.shard
        first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else shard
        spans = list(zip(first.tolist(), np.append(first[1:], len(shard)).tolist(), strict=True))
        size = np.fromiter(map(len, unit.texts), np.int64, len(unit.texts))
        return pa.table([pa.array(shard[first]), pa.array([key[0].as_py()] * len(first), pa.int64()), pa.array([b"".join(unit.texts[a:b]) for a, b in spans], pa.binary()), pa.array([size[a:b].astype("<i4").tobytes() for a, b in spans], pa.binary()), pa.array([unit.least[a:b].astype("<i8").tobytes() for a, b in spans], pa.binary())], names=["shard", "unit", "data", "lens", "least"])

    return run


def first_owners(texts: list[bytes], least: np.ndarray, length: int) -> np.ndarray:
    """For each window of the different texts in order: the least id of a text that has it."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\0".join(texts) + b"\0" * 64, np.uint8)
    n = int(size.sum()) + len(texts)
    symbols = data[:n].astype(np.int16) + np.int16(1)
    begin = np.cumsum(size + 1) - size - 1
    symbols[begin + size] = 0
    order = suffix_array(symbols, 257)
    of = np.repeat(np.arange(len(texts)), size + 1)
    starts = np.arange(n) + length <= np.repeat(begin + size, size + 1)
    common = permuted_prefixes(data, order, np.concatenate([starts, np.zeros(len(data) - n, bool)]), length)
    ranked = order[starts[order]]
    group = np.flatnonzero(common[ranked] < length)
    low = np.minimum.reduceat(least[of[ranked]], group)
    owner = np.empty(n, np.int64)
    owner[ranked] = np.repeat(low, np.diff(np.append(group, len(ranked))))
    return owner[starts]


def sort_shard(plan: Plan) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        got = grouped(rows)
        table: dict[bytes, int] = {}
        each = []
        for data, lens in zip(got["data"], got["lens"], strict=True):
            edge = np.concatenate(([0], np.cumsum(np.frombuffer(lens, "<i4")))).tolist()
            each.append(np.fromiter((table.setdefault(data[a:b], len(table)) for a, b in zip(edge, edge[1:], strict=False)), np.int64, len(edge) - 1))
        least = np.full(len(table), WHOLE)
        for of, ids in zip(each, got["least"], strict=True):
            np.minimum.at(least, of, np.frombuffer(ids, "<i8"))
        texts = list(table)
        owner = first_owners(texts, least, plan.length)
        windows = np.fromiter(map(len, texts), np.int64, len(texts)) - plan.length + 1
        first = np.cumsum(windows) - windows
        lens, data = [], []
        for of in each:
            n = windows[of]
            own = owner[np.repeat(first[of], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            change = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            lens.append(np.diff(np.append(change, len(own))).astype("<i4").tobytes())
            data.append(own[change].astype("<i8").tobytes())
        return message(got["unit"], 1, [key[0].as_py()] * len(each), lens, data)

    return run


def owners_of(rows: pa.Table) -> np.ndarray:
    got = grouped(rows)
    parts = sorted(((k, lens, data) for kind, k, lens, data in zip(got["kind"], got["at"], got["lens"], got["data"], strict=True) if kind == 1), key=lambda x: x[0])
    return np.concatenate([np.repeat(np.frombuffer(data, "<i8"), np.frombuffer(lens, "<i4")) for _, lens, data in parts]) if parts else np.zeros(0, np.int64)


Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


def kept(unit: Unit, spans: Spans) -> list[bytes]:
    """What is left of each text's bytes."""
    data, at = unit.flat.tobytes(), unit.at.tolist()
    out = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
    edge = np.searchsorted(spans[0], np.arange(len(out) + 1))
    begins, ends = spans[1].tolist(), spans[2].tolist()
    for i in np.flatnonzero(np.diff(edge)).tolist():
        left = [at[i], *ends[edge[i] : edge[i + 1]]]
        out[i] = b"".join(data[a:b] for a, b in zip(left, [*begins[edge[i] : edge[i + 1]], at[i + 1]], strict=True))
    return out


def digest_rows(unit: Unit, spans: Spans) -> pa.Table:
    n = len(unit.at) - 1
    texts = kept(unit, spans)
    size = np.diff(unit.at)
    removed = size - np.fromiter(map(len, texts), np.int64, n)
    return pa.table([unit.rows.column("doc_id"), pa.array(size), pa.array(removed), pa.array(np.bincount(spans[0], minlength=n).astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept_rows(columns: list[str]) -> Callable[[Unit, Spans], pa.Table]:
    """The unit's rows with what is left of their texts; characters that lost some of their bytes go whole."""

    def run(unit: Unit, spans: Spans) -> pa.Table:
        null = unit.rows.column("text").is_null().to_pylist()
        texts = [None if no else t.decode("utf-8", "ignore") for t, no in zip(kept(unit, spans), null, strict=True)]
        new = {"text": pa.array(texts, pa.string())}
        if "n_chars" in columns:
            new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        return pa.table([new.get(c, unit.rows.column(c)) for c in columns], names=columns)

    return run


def dedupe(docs: DataFrame, finish: Callable[[Unit, Spans], pa.Table], schema: str | T.StructType, length: int = LENGTH) -> DataFrame:
    """docs: doc_id long, text string and any more columns. finish(unit, runs of bytes that go) gives a unit's result."""
    if length < GRAM:
        raise ValueError(f"strings of fewer than {GRAM} bytes have no minimizer")
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    plan = Plan(total, length)
    unit = F.pmod(F.xxhash64(F.lit("unit"), F.coalesce("doc_id", F.lit(WHOLE))), F.lit(plan.units))
    # a partition holds one unit, or more of them once there are very many
    dealt = docs.withColumn("__unit", unit).repartition(min(plan.units, 1 << 16), "__unit")
    sent = dealt.groupBy("__unit").applyInArrow(tidied(send_minimizers(plan)), "bucket long, unit long, data binary, shared binary")
    marks = sent.groupBy("bucket").applyInArrow(tidied(mark_repeated(plan)), MESSAGE)
    strings = dealt.groupBy("__unit").cogroup(marks.groupBy("unit")).applyInArrow(tidied(send_strings(plan)), "shard long, unit long, data binary, lens binary, least binary")
    owners = strings.groupBy("shard").applyInArrow(tidied(sort_shard(plan)), MESSAGE)

    def remove(key: tuple, rows: pa.Table, messages: pa.Table) -> pa.Table:
        own = Unit(rows, plan)
        own.strings(*marks_of(messages))
        return finish(own, own.removed(owners_of(messages)))

    return dealt.groupBy("__unit").cogroup(marks.unionByName(owners).groupBy("unit")).applyInArrow(tidied(remove), schema)


def digests(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return dedupe(docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")), digest_rows, DIGESTS, length)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text and any more columns) with repeated strings cut from their texts."""
    return dedupe(docs, kept_rows(docs.columns), docs.schema, length)
