from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import embedding_dedup as ed


def brute(rows, threshold=0.93):
    """vec_id of row: (links, component); rows: vec_id, vector, label."""
    good = [i for i, (d, v, k) in enumerate(rows) if d is not None and k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            i, j = good[a], good[b]
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i in good:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((str(d), links[i], str(least[find(i)] if i in good else d)) for i, (d, _, _) in enumerate(rows))


def made(seed, n=700, dim=24):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(size=dim).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    centers = rng.normal(size=(12, dim))
    for k in range(260):
        c = k % 12 if k < 120 else 0  # one large family
        rows.append((1000 + k, (centers[c] + rng.normal(size=dim) * 0.17).astype(np.float32).tolist(), c % 3))
    rows += [(3000 + k, rows[5][1], rows[5][2]) for k in range(9)] + [(3100, rows[5][1], 99), (3101, (np.array(rows[5][1], np.float32) * 4).tolist(), rows[5][2])]
    return rows


def test_result_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ed, "CHUNK", 50)
    rows = made(1)
    rows += [(4000, None, 1), (4001, [], 1), (4002, [0.0] * 24, 1), (4003, [float("nan")] * 24, 1), (4004, [1.0, None] * 12, 1), (4005, [float("inf")] * 24, 1), (4006, rows[0][1], None), (None, rows[0][1], rows[0][2]), (4007, [1.0, 2.0], 1), (4008, [2.0, 4.0], 1), (4009, [1e30] * 3, 1), (4010, [1e-30] * 3, 1), (4011, [-0.0, 1.0], 7), (4012, [0.0, 1.0], 7)]
    df = spark.createDataFrame([(d, v, k, 5) for d, v, k in rows], "vec_id long, embedding array<float>, label int, node int")
    counts = []
    got = ed.near_duplicates(df, report=lambda true, found: counts.append((true, found))).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert counts[-1][1] >= 0.97 * counts[-1][0]
    assert ed.near_duplicates(df.where("false")).collect() == []


@pytest.mark.parametrize("sample", [1 << 14, 2])
def test_recall_with_coarse_trees(spark, monkeypatch, sample):
    monkeypatch.setattr(ed, "TASK", 150)
    monkeypatch.setattr(ed, "SAMPLE", sample)  # too small a sample: planes in the place of trees
    rows = made(2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {str(r["vec_id"]): r["n_links"] for r in ed.near_duplicates(df).collect()}
    want = {d: n for d, n, _ in brute(rows)}
    assert sum(min(got[d], n) for d, n in want.items()) >= 0.95 * sum(want.values())
    assert all(got[d] <= n for d, n in want.items())


def test_repeated_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)]
    got = sorted(tuple(r) for r in ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("n", [1, 96, 97, 1000])
def test_leaves_hold_every_row_once(n):
    x = np.random.default_rng(n).normal(size=(n, 5))
    own = np.concatenate(list(ed.leaves(x, np.random.default_rng(0))))
    assert sorted(own.tolist()) == list(range(n))


def test_tight_groups_of_one_family_stay_together(spark):
    """Three groups whose lists fill up with members of their own group, though each links to the other groups."""
    rng = np.random.default_rng(5)
    base = np.linalg.qr(rng.normal(size=(64, 4)))[0].T
    angle = math.sqrt(1 / 0.946 - 1)  # cosine of about 0.946 between centers
    rows = []
    for g in range(3):
        center = base[0] + angle * base[1 + g]
        for k in range(150):
            rows.append((g * 1000 + k, (center / np.linalg.norm(center) + rng.normal(size=64) * 0.0025).tolist(), 1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in ed.near_duplicates(df).collect())
    assert got == brute(rows)
    assert {c for _, _, c in got} == {"0"} and {n for _, n, _ in got} == {449}


def test_sparse_pairs_are_reached_over_weak_edges(spark, monkeypatch):
    """Pairs among unrelated vectors: their only strong edge is the one looked for, and few share a leaf."""
    for name, value in (("TREES", 2), ("LEAF", 48), ("FORESTS", 1)):
        monkeypatch.setattr(ed, name, value)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24))
    x[1500:1800] = x[:300] + rng.normal(size=(300, 24)) * 0.25
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    nodes = ed.cut(df.mapInArrow(ed.prepare, "vec_id long, label int, dim int, v binary").withColumnRenamed("vec_id", "node"))
    graph = ed.refine(ed.forest_edges(nodes, 0).withColumn("fresh", F.lit(True)), nodes, 0.93, ed.ROUNDS)
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in graph.where("s >= 0.93").collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set(zip(*(k.tolist() for k in np.nonzero(np.triu(y @ y.T >= 0.93, 1))), strict=True))
    assert len(want) > 200 and got <= want and len(got) >= 0.97 * len(want)


@pytest.mark.parametrize("small", [0, 4096])
def test_labels_that_miss_the_target_are_compared_whole(spark, monkeypatch, small):
    """A family that is found at once doesn't outweigh sparse pairs that the graph misses, in its own label or in another."""
    for name, value in (("SMALL", small), ("TREES", 1), ("LEAF", 12), ("ROUNDS", 0), ("FORESTS", 1), ("EVIDENCE", 5)):
        monkeypatch.setattr(ed, name, value)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 24))
    x[600:700] = x[:100] + rng.normal(size=(100, 24)) * 0.25
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(5000 + i, (x[0] + rng.normal(size=24) * 0.05).tolist(), 0) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    counts = []
    got = ed.near_duplicates(df, report=lambda true, found: counts.append((true, found))).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == brute(rows)
    assert counts and (small or counts[-1][1] < counts[-1][0])


@pytest.mark.parametrize("sample", [1 << 14, 2])
def test_graph_of_labels_over_several_tasks(spark, monkeypatch, sample):
    for name, value in (("SMALL", 0), ("TASK", 150), ("SAMPLE", sample), ("EVIDENCE", 1)):
        monkeypatch.setattr(ed, name, value)
    rows = made(2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    counts = []
    got = {str(r["vec_id"]): r["n_links"] for r in ed.near_duplicates(df, report=lambda true, found: counts.append((true, found))).collect()}
    want = {d: n for d, n, _ in brute(rows)}
    assert all(got[d] <= n for d, n in want.items()) and sum(got.values()) >= 0.97 * sum(want.values())
    assert len(counts) <= ed.FORESTS


def test_results_are_the_same_on_both_sides_of_the_switch(spark, monkeypatch):
    """A descent that misses links, and whose recall is called good enough, leaves none out of the result."""
    for name, value in (("TREES", 1), ("LEAF", 12), ("ROUNDS", 0), ("FORESTS", 1), ("EVIDENCE", 0), ("TARGET", 0.0)):
        monkeypatch.setattr(ed, name, value)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 24))
    x[300:400] = x[:100] + rng.normal(size=(100, 24)) * 0.25
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    counts = []
    got = []
    for small in (0, 4096):
        monkeypatch.setattr(ed, "SMALL", small)
        got.append(sorted(tuple(r) for r in ed.near_duplicates(df, report=lambda true, found: counts.append((true, found))).collect()))
    assert got[0] == got[1] and counts[0][1] < counts[0][0]
