from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing, token_counts

ODD = [None, "", " ", "\n\n\t", "Hello World", "ΑΣ ΣΑΣ İx ſ", "a" * 5000, "<|endoftext|>a<|startoftext|> <|endoftext|>", "it's I'LL we'Ve 3.14 ½ ²", "café   x\x1cy\x85z", "日本語テキスト", "!!!???...", "é<|endoftext|>́", "x" + " " * 3000 + "y", "Ωµ Å ​ zero", "aaaa " * 4000, "\U0001f600\U0001f600 ok"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")


def test_token_counts_equal_the_library(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(chr(rng.choice([*range(32, 127), *range(0xC0, 0x250), *range(0x370, 0x400), 0x2009, 0x300])) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["".join(chr(c) for c in range(a, a + 256)) for a in range(0, 0x3000, 256)]
    got = {r["doc_id"]: r for r in token_counts.token_counts(frame(spark, texts)).collect()}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(lib.encode(t or "", add_special_tokens=False).ids), repr(t)
        assert got[i]["n_bytes"] == len((t or "").encode())
        assert got[i]["over_limit"] == (got[i]["n_tokens"] > 2048)


def test_token_counts_of_an_empty_table(spark):
    assert token_counts.token_counts(frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_every_piece_and_overlaps_none(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 100, 2048])
    counts = {}
    for _ in range(rng.randint(0, 300)):
        x = rng.randint(1, capacity)
        counts[x] = counts.get(x, 0) + rng.choice([1, 1, 2, 9])
    slots, n = packing.plan(counts, capacity)
    used = {}
    for i, (x, first, sequence, each, offset) in enumerate(slots):
        last = slots[i + 1][1] if i + 1 < len(slots) and slots[i + 1][0] == x else counts[x]
        for k in range(last - first):
            used.setdefault(sequence + k // each, []).append((offset + k % each * x, x))
    assert len(used) == n
    for inside in used.values():
        at = 0
        for offset, x in sorted(inside):
            assert offset == at
            at += x
        assert at <= capacity
    total = sum(x * k for x, k in counts.items())
    assert n <= 1.7 * -(-total // capacity) + 1


def optimum(items, capacity):
    best = len(items)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in sorted({b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values()):
            put(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_an_optimum(seed):
    """What the reduction fixes and the best packing of the rest need no more bins than the best packing of all."""
    rng = random.Random(seed)
    capacity = 20
    items = sorted((rng.randint(2, 20) for _ in range(rng.randint(1, 9))), reverse=True)
    counts = {x: items.count(x) for x in items}
    fixed = sum(n for _, n in packing.reduce_dominated(counts, capacity))
    rest = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)
    assert fixed + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity)


@pytest.mark.parametrize("seed", range(40))
def test_taking_many_bins_at_once_changes_no_plan(seed, monkeypatch):
    rng = random.Random(seed)
    capacity = rng.choice([20, 50, 2048])
    counts = {rng.randint(1, capacity): rng.choice([1, 2, 3, 5, 8, 30]) for _ in range(rng.randint(1, 30))}

    def total():
        out = {}
        for content, n in packing.reduce_dominated(dict(counts), capacity):
            out[content] = out.get(content, 0) + n
        return out

    many = total()
    monkeypatch.setattr(packing, "PLENTY", 1 << 60)
    assert many == total()


def test_the_plan_does_not_grow_with_the_documents():
    sizes = {len(packing.plan({600: n, 700: 2 * n}, 2048)[0]) for n in (100, 10_000, 1_000_000)}
    assert len(sizes) == 1 and sizes.pop() < 20


@pytest.mark.parametrize("empty", [None, ""])
def test_ids_that_are_null_or_repeated(spark, empty):
    rows = [(None, "one", 7, 7), (None, "one", 7, 7), (4, "two", 7, 7), (4, "two words", 7, 7), (4, empty, 7, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int, length long")
    got = packing.pack_documents(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["4", "4", "4", "None", "None"]
    assert sorted(r["offset"] for r in got)[0] == 0 and len({(r["sequence_id"], r["offset"]) for r in got}) == 5
    counted = token_counts.token_counts(docs.withColumnRenamed("length", "n_bytes")).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in counted) == [("4", 0), ("4", 1), ("4", 2), ("None", 1), ("None", 1)]


def test_long_words_equal_the_library():
    rng = random.Random(8)
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    words = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "aet", "abcdefghijklmnopqrstuvwxyz", "éñüa") for n in (513, 700, 4000)] + ["a" * 5001, "the" * 2000, "a" * 512, "z" * 513]
    want = [len(lib.encode(w, add_special_tokens=False).ids) for w in words]
    assert token_counts.long_survivors(words, path).tolist() == want
    assert token_counts.Counter(path).count(words).tolist() == want


def test_a_word_of_a_megabyte():
    rng = random.Random(9)
    path = public_tokenizers.path("word_bpe_49k.json")
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    counter = token_counts.Counter(path)
    assert counter.count([word]).tolist() == [len(Tokenizer.from_file(path).encode(word, add_special_tokens=False).ids)]
    assert not counter.memo


def test_pieces_equal_the_library_and_fill_sequences(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["alpha", "Beta", "gamma,", "déjà", "42"]) for _ in range(rng.randint(0, 3000))) for _ in range(60)] + ["same text"] * 40
    rows = packing.pack_documents(frame(spark, texts)).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == 2048 or k == 0
            at += r["length"]
        assert at == len(ids)
    for inside in by_sequence.values():
        at = 0
        for offset, n in sorted(inside):
            assert offset == at
            at += n
        assert at <= 2048


def test_packing_an_empty_table(spark):
    assert packing.pack_documents(frame(spark, [])).collect() == []
