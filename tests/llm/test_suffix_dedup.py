from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from quillspark.llm import suffix_dedup as sd
from quillspark.llm import suffix_sort
from quillspark.llm.suffix_sort import permuted_prefixes, suffix_array


def brute(rows, length=50):
    rows = [(2**63 - 1 if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in sorted(rows):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], d)
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    words = [word() for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(rng.randint(8, 60)) for _ in range(15)]
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 51), (6, "x" * 500), (7, "ab" * 300), (8, "ba" * 100), (9, "\0" * 120), (10, "\0" * 80 + "y"), (11, prose(30_000))]
    for d in range(100, 220):
        parts = [prose(rng.randint(0, 40)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(0, 6))]
        rows.append((d, rng.choice(["", " ", "\n"]).join(parts)))
    rows += [(d + 500, t) for d, t in rows[20:40]] + [(700, rows[30][1]), (700, rows[30][1]), (None, rows[31][1]), (None, rows[31][1]), (None, prose(50)), (-5, rows[60][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("unit_bytes", "hot_units", "salt_bytes"), [(1 << 24, 1024, 1 << 36), (40_000, 1024, 1 << 36), (40_000, 1, 1 << 36), (40_000, 3, 20_000), (40_000, 0, 1 << 10)])
def test_digests_equal_brute_force(spark, monkeypatch, unit_bytes, hot_units, salt_bytes):
    """hot_units: windows in so many units are dealt out singly (0: all); salt_bytes: as for larger inputs."""
    monkeypatch.setattr(sd, "UNIT_BYTES", unit_bytes)
    monkeypatch.setattr(sd, "HOT_UNITS", hot_units)
    monkeypatch.setattr(sd, "SALT_BYTES", salt_bytes)
    if salt_bytes < 1 << 20:
        monkeypatch.setattr(sd, "BUCKET_SIZE", 1)  # as many buckets as for 10 TB
    rows = made(1)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, unit int")
    got = sorted((2**63 - 1 if r[0] is None else r[0], *r[1:]) for r in sd.digests(df).collect())
    assert got == brute(rows)
    assert sum(r[2] > 0 for r in got) > 40


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(tuple(r) for r in sd.digests(docs).collect()) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_without_repeats_keeps_columns_and_whole_characters(spark):
    rows = [(1, "é" * 40, 40, "s"), (2, "é" * 30 + "z", 31, None), (3, None, None, "t"), (4, "aé" + "b" * 60 + "c", 63, "u"), (5, "b" * 60, 60, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, source string")
    got = {r["doc_id"]: r for r in sd.without_repeats(df).collect()}
    assert got[1]["text"] == "é" * 40 and got[3]["text"] is None and got[3]["n_chars"] is None
    assert got[2]["text"] == "z" and got[2]["n_chars"] == 1 and got[5]["text"] == "" and got[4]["text"] == rows[3][1]
    assert sd.without_repeats(df).schema == df.schema
    assert sd.without_repeats(df.where("false")).collect() == [] == sd.digests(df.where("false")).collect()


@pytest.mark.parametrize("seed", range(40))
def test_permuted_prefixes(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 90))) for _ in range(20)]
    strings += strings[:3] + [b"a" * 70]
    data = np.frombuffer(b"\0".join(strings) + b"\0" * 64, np.uint8)
    n = sum(map(len, strings)) + len(strings)
    order = suffix_array(data[:n].astype(np.int16) + (data[:n] > 0), 257)
    starts = np.zeros(len(data), bool)
    for i in range(n):
        starts[i] = 0 not in data[i : i + 20].tolist()
    common = permuted_prefixes(data, order, starts, 20)
    marked = order[starts[order]].tolist()
    raw = data.tobytes()
    want = dict.fromkeys(marked[:1], 0)
    for i, j in zip(marked, marked[1:], strict=False):
        want[j] = next((k for k in range(20) if raw[i + k] != raw[j + k]), 20)
    assert {i: int(common[i]) for i in marked} == want and common.sum() == sum(want.values())


@pytest.mark.parametrize("repeated", [0, 64])
@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed, repeated, monkeypatch):
    monkeypatch.setattr(suffix_sort, "REPEATED", repeated)
    rng = random.Random(seed)
    strings = [[rng.randint(1, rng.choice([2, 5])) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 12))]
    if seed % 3 == 0:
        strings += strings
    text = np.array([x for s in strings for x in [*s, 0]], np.int16)
    ends = np.flatnonzero(text == 0).tolist()

    def key(i):
        end = next(e for e in ends if e >= i)
        return [(x, 0) for x in text[i:end].tolist()] + [(0, end)]

    assert suffix_array(text, 6).tolist() == sorted(range(len(text)), key=key)
