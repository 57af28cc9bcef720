from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
import xxhash

from quillspark.llm import simhash
from quillspark.llm.components import components


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    votes = [sum(xxhash.xxh64_intdigest(p, 42) >> b & 1 for p in parts) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(parts))


def brute_components(rows):
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 4):
            parent[find(fps[i])] = find(fps[i + 1 + j])
    least = {}
    for d, f in rows:
        least[find(f)] = min(least.get(find(f), d), d)
    return {d: least[find(f)] for d, f in rows}


def test_whole_operator_equals_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    base = [[rng.choice(words) for _ in range(rng.choice([60, 400, 900]))] for _ in range(12)]
    texts = [None, "", " \t\n", "One", "one two", "A b C", "a b c d", "é É x\x1cy \x85 z", "tab\tsep\vx y"]
    for _ in range(250):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 5])):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(rng.choice([" ", "\n", "  "]).join(own))
    texts += texts[20:60] + [" ".join(rng.choices(words, k=40000))]
    ids = rng.sample(range(10_000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts, ids, strict=True)), "doc_id long, text string, fp long")
    got = simhash.near_duplicates(df).collect()
    want = [(d, brute_fingerprint(t)) for d, t in zip(ids, texts, strict=True)]
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {d: f"{f:016x}" for d, f in want} and len(got) == len(ids)
    component = brute_components(want)
    assert {r["doc_id"]: r["component_id"] for r in got} == component
    assert simhash.near_duplicates(df.where("false")).collect() == []


@pytest.mark.parametrize("n", [1, 1 << 21, 1 << 28])
def test_buckets_catch_every_pair(n):
    rng = random.Random(n)
    masks = simhash.bucket_masks(n)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("large", [0, 3, 10**9])
def test_groups_find_all_connections(seed, large, monkeypatch):
    rng = np.random.default_rng(seed)
    centers = rng.integers(0, 2**63, 6).astype(np.uint64)
    fp = centers[rng.integers(0, 6, 700)]
    for _ in range(rng.integers(1, 6)):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))
    fp = np.unique(fp)
    monkeypatch.setattr(simhash, "LARGE", large)
    u, v = simhash.links_of(np.zeros(len(fp), np.int64), fp)
    root = dict(zip(u.tolist(), v.tolist(), strict=True))
    want = brute_components([(int(f.view(np.int64)), int(f)) for f in fp])
    assert {int(f.view(np.int64)): root.get(int(f.view(np.int64)), int(f.view(np.int64))) for f in fp} == want


def test_a_hot_bucket_of_unrelated_fingerprints():
    """40,000 fingerprints share a block; among them are chains of close ones and a dense family."""
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 40_000).astype(np.uint64) & ~np.uint64(0x1FFF)
    fp[30_000:35_000] = fp[:5_000] ^ (np.uint64(0x11) << rng.integers(13, 58, 5_000).astype(np.uint64))
    dense = fp[0] ^ (np.uint64(1) << rng.integers(13, 63, 3_000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(13, 63, 3_000).astype(np.uint64))
    fp = np.unique(np.concatenate([fp, dense]))
    began = time.perf_counter()
    u, v = simhash.links_of(np.zeros(len(fp), np.int64), fp)
    assert time.perf_counter() - began < 10
    root = dict(zip(u.tolist(), v.tolist(), strict=True))
    near = {int(x): root.get(int(x), int(x)) for x in fp.view(np.int64)}
    some = rng.choice(len(fp), 400, replace=False)
    for i in some:
        close = fp[np.bitwise_count(fp ^ fp[i]) <= 4].view(np.int64).tolist()
        assert len({near[x] for x in close}) == 1
    assert len(set(near.values())) > 25_000


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (None, "x y z"), (4, "a b c d e"), (4, "a b c d e"), (4, "x y z"), (2, "other words are here"), (2, "other words are here")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id AS component_id")).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == [("2", 2), ("2", 2), ("4", 4), ("4", 4), ("4", 4), ("None", 4), ("None", 4), ("None", 4)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1400)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(350)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long").repartition(7)).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if find(x) != x}
