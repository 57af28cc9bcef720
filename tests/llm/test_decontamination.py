from __future__ import annotations

import random
import re
import time
import unicodedata
from itertools import combinations
from math import ceil

import pyarrow as pa
import pytest

from quillspark.llm import decontamination as dec


UNSPACED = "\u0e00-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u4dbf\u4e00-\u9fff"


def split(text):
    """Tokens, and how many of them are single characters."""
    out = re.findall(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+", (text or "").lower())
    out = [x for x in out if unicodedata.category(x[0])[0] in "LMN"]
    return out, sum(re.fullmatch(f"[{UNSPACED}]", x) is not None for x in out)


def brute(docs, items):
    """All pairs by laying every item at every place of every text."""
    out = set()
    for d, text in docs:
        a, _ = split(text)
        for i, item in items:
            b, singles = split(item)
            if 2 * len(b) - singles < 10:
                if b and a == b:
                    out.add((d, i))
                continue
            w = min(26 if 2 * singles > len(b) else 13, len(b))
            for diagonal in range(-len(b), len(a)):
                equal = [int(0 <= k + diagonal < len(a) and a[k + diagonal] == b[k]) for k in range(len(b))]
                inside = [0 <= k + diagonal < len(a) for k in range(len(b))]
                if any(sum(equal[k : k + w]) >= ceil(0.8 * w) and all(inside[k : k + w]) for k in range(len(b) - w + 1)):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("n", range(5, 30))
def test_masks_hit_every_window(n):
    w = min(n, 13)
    masks = dec.masks_for(n)
    for bad in combinations(range(w), w - dec.needed(w)):
        if n < 13:
            starts, hit = range(n), False
            hit = any(not {o + i for i in m} & set(bad) for m in masks for o in starts if o + m[-1] < n)
        else:
            hit = any(not {o + i for i in m} & set(bad) for m in masks for o in range(13 - m[-1]))
        assert hit


@pytest.mark.parametrize("slice_bytes", [1 << 20, 150])
def test_overlaps_equal_brute_force(spark, monkeypatch, slice_bytes):
    rng = random.Random(1)
    words = ["the", "of", "Éa", "x1", "na", "or", "Zed", "q", "été", "five"]
    monkeypatch.setattr(dec, "SLICE_BYTES", slice_bytes)
    items = [(i, " ".join(rng.choice(words) + str(rng.randint(0, 6)) for _ in range(rng.choice([1, 4, 5, 7, 9, 10, 12, 13, 14, 20, 40])))) for i in range(40)]
    docs = []
    for d in range(120):
        body = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        own = items[rng.randrange(40)][1].upper().replace("É", "É").split()
        for k in range(len(own)):
            if rng.random() < 0.12:
                own[k] = "sub"
        if rng.random() < 0.3:
            own = own[: rng.randint(0, len(own))]
        docs.append((d, " ".join([*body, *own, *body[:5]])))
    docs += [(500, None), (501, ""), (502, "...")]
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id AS item_id")
    items += [(None, "the of na or q x1 five the the"), (90, "..."), (91, "of")]
    docs += [(503, "Of!"), (504, "of of")]
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id AS item_id")
    b = spark.createDataFrame([*items, *items[:5], (77, None)], "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = dec.overlaps(a, b).collect()
    want = brute(docs, items)
    assert (503, 91) in want and (504, 91) not in want
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 30
    kept = dec.clean(a, b).collect()
    assert {r["doc_id"] for r in kept} == {d for d, _ in docs} - {d for d, _ in want}
    assert dec.overlaps(a.where("false"), b).collect() == [] == dec.overlaps(a, b.where("false")).collect()


@pytest.mark.parametrize("n", range(10, 32))
def test_masks_hit_every_wide_window(n):
    """Differences are placed at random, as there are too many ways for all of them."""
    rng = random.Random(n)
    w = min(n, 26)
    for _ in range(800):
        bad = set(rng.sample(range(w), w - dec.needed(w)))
        assert any(not {o + i for i in m} & bad for m in dec.masks_for(n, 26) for o in range(w - m[-1]))


def test_scripts_without_blanks(spark):
    rng = random.Random(6)
    zh = lambda n: "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(n))
    th = lambda n: "".join(chr(rng.randrange(0x0E01, 0x0E2E)) for _ in range(n))
    items = [(i, (zh, th)[i % 2](rng.choice([5, 9, 10, 14, 25, 26, 40, 60]))) for i in range(40)] + [(50, "Mixed words with " + zh(9)), (51, zh(30) + "。" + zh(30))]
    docs = [(i, zh(20) + "，" + items[i][1] + "。" + th(10)) for i in range(len(items))] + [(100 + i, items[i][1]) for i in range(len(items))] + [(200 + k, zh(300) + th(300)) for k in range(30)]
    for k in range(60):
        own = list(items[rng.randrange(len(items))][1])
        for j in range(len(own)):
            if rng.random() < 0.15:
                own[j] = "一"
        docs.append((300 + k, th(5) + "".join(own) + zh(5)))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = {(r["doc_id"], r["item_id"]): r for r in dec.overlaps(a, b).collect()}
    assert set(got) == want and all((100 + k, i) in want for k, (i, _) in enumerate(items)) and len(want) > 100
    assert all(got[100 + k, i]["similarity"] == 1 and got[100 + k, i]["n_match"] == len(split(t)[0]) for k, (i, t) in enumerate(items))
    assert {r["doc_id"] for r in dec.clean(a, b).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_repeated_documents_and_items(spark):
    text = "one two three four five six seven"
    a = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "other")], "doc_id long, text string")
    b = spark.createDataFrame([(7, text), (7, text), (7, text + " eight"), (None, text)], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["n_match"], r["n_item"]) for r in dec.overlaps(a, b).collect()]
    assert sorted(map(str, got)) == sorted(str((d, *x)) for d in (1, 1, None) for x in ((7, 7, 7), (None, 7, 7)))
    assert [r["doc_id"] for r in dec.clean(a, b).collect()] == [2]


def test_a_phrase_that_many_items_and_a_long_text_share():
    """20,000 items share 8 words that a text has 100 times; and a text of a megabyte."""
    rng = random.Random(3)
    phrase = "which of the following best describes the author"
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [f"{word()} {word()} {phrase} {' '.join(word() for _ in range(10))}" for _ in range(20_000)]
    table = dec.Items(items)
    text = " ".join(f"{phrase} {word()} {word()} {word()}" for _ in range(100))
    long = " ".join(word() for _ in range(130_000)) + " " + items[77] + " " + " ".join(word() for _ in range(10))
    hashes, at, _ = dec.tokens(pa.array([text, long, items[5]]))
    began = time.perf_counter()
    t, i, same = table.best(hashes, at, table.found(hashes, at))
    assert time.perf_counter() - began < 20
    assert list(zip(t.tolist(), i.tolist(), same.tolist(), strict=True)) == [(1, 77, 20), (2, 5, 20)]


def test_whole_passages_in_the_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    b = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in dec.overlaps(d, b).collect()}
    items = b.collect()
    assert {(r["doc_id"], i["item_id"]) for r in d.collect() for i in items if i["text"] in r["text"]} <= found
