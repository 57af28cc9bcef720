from __future__ import annotations

import random

import corpus_pipeline
from quillspark.llm import near_copies


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_stage_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    base = [[rng.choice(words) for _ in range(rng.choice([60, 200, 500]))] for _ in range(20)]
    texts = [None, "", "  ", "one", "one two", "a b c d e", "a b c d e f"]
    for _ in range(240):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 3, 6])):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, source string")
    want = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df).collect()} == want
    kept = corpus_pipeline.one_of_near_copies(spark, df, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == df.columns
    assert near_copies.near_copies(df.where("false")).collect() == []


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, null ids, and an id with two texts of which one copies a smaller id."""
    say = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(1, say("a")), (1, say("a")), (2, say("b")), (3, say("a")), (3, say("c")), (None, say("a")), (None, say("d")), (None, say("d") + " more"), (None, None), (5, ""), (6, say("e")), (6, say("f"))]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, digest int")
    kept = sorted((str(r["doc_id"]), (r["text"] or "")[:2]) for r in near_copies.one_of_each(df).collect())
    assert kept == [("1", "aw"), ("2", "bw"), ("3", "cw"), ("5", ""), ("6", "ew"), ("6", "fw"), ("None", "dw")]
    assert near_copies.one_of_each(df).schema == df.schema and near_copies.one_of_each(df.where("false")).collect() == []
