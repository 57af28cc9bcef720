from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import language_id, ngrams, quality
from quillspark.llm.common import utf8
from quillspark.llm.ngrams import runs, slice_hashes

DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS)


def test_language_id_on_held_out_rows(spark, docs):
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = language_id.identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.98


def test_language_id_learns_from_allowed_rows_only(spark, docs):
    changed = docs.selectExpr("doc_id", "text", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1, 'xx', lang) AS lang", "source")
    a = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert a == {r["doc_id"]: r["lang_pred"] for r in language_id.identify(changed).collect()}


def test_language_id_of_odd_rows(spark):
    rows = [(1, None, "en", 1.0), (2, "", "en", 1.0), (3, "12 + 3 = !", None, 2.0), (None, "the house", "en", 0.0), (5, "the tree", "en", 0.0), (5, "the tree", "en", 0.0), (6, "das Haus der", "de", 0.0), (7, "der Baum", "de", 0.0), (8, "Ж", "de", 0.0), (9, "der " * 50000, "de", 0.0), (10, "the big dog", "en", 0.0)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert by[8]["lang_pred"] != "und" and by[9]["lang_pred"] == "de"
    assert language_id.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    nothing = language_id.identify(spark.createDataFrame([(1, "hallo", None)], "doc_id long, text string, lang string")).collect()
    assert nothing[0]["lang_pred"] == "und"


def test_codewords_are_apart():
    for k in (2, 3, 4, 7, 12, 40):
        code = language_id.codewords(k).astype(int)
        apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(apart) >= (1 if k == 2 else code.shape[1] // 4)


def test_a_wrong_bit_is_corrected():
    model = language_id.Model(["a", "b", "c", "d"], language_id.codewords(4), None, None, np.ones(7))
    for k in range(4):
        for bit in range(7):
            z = 3.0 * model.codes[k].astype(float)
            z[bit] = -z[bit]
            assert language_id.losses(z[None], model).argmin() == k


def test_quality_on_held_out_rows(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(rows) == docs.count()
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) > 0.93


def test_quality_of_odd_rows(spark):
    rows = [(1, None, 3.0), (2, "", 3.0), (3, "good words here", 3.0), (3, "good words here", 3.0), (4, "BAD!! BAD!!", 3.0), (None, "x", 3.0), (6, "word " * 40000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (None, 1), (1, None)], "doc_id long, quality int")
    got = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    none = quality.score(docs, quality.learn(docs, labels.where("false"))).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score(docs.where("false"), quality.learn(docs.where("false"), labels)).collect() == []


MASK = (1 << 64) - 1


def crc(key):
    return zlib.crc32(("" if key is None else str(key)).encode())


def brute_grams(text):
    low = "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" else c for c in text).encode()
    b = [x if 97 <= x <= 122 or x >= 128 else 32 for x in low]
    two = [x | y << 8 for x, y in zip(b, b[1:], strict=False)]
    three = [((x | y << 8 | z << 16) * 0x9E3779B1 % (1 << 32) >> 16) + (1 << 16) for x, y, z in zip(b, b[1:], b[2:], strict=False)]
    return two + three, len(b)


def brute_languages(rows):
    """lang_pred and score of each row, refitted with dicts and loops on all rows that may be learned from."""
    train = [(t, k) for d, t, k in rows if t is not None and k and k.strip() and crc(d) % 3 != 1]
    languages = sorted({k for _, k in train})
    codes = language_id.codewords(len(languages)).astype(int).tolist()
    count = {k: Counter() for k in languages}
    for t, k in train:
        grams, n = brute_grams(t)
        for g in grams:
            count[k][g] += min(1, 65536 / max(1, n))
    total = {k: max(1, sum(c.values())) for k, c in count.items()}
    bits = len(codes[0])

    @cache
    def weight(b, g):
        side = {s: [count[k][g] / total[k] + 1e-6 for i, k in enumerate(languages) if codes[i][b] == s] for s in (1, -1)}
        return math.log(sum(side[1]) / len(side[1])) - math.log(sum(side[-1]) / len(side[-1]))

    @cache
    def margin(t):
        grams, n = brute_grams(t)
        n = max(1, n)
        return [sum(weight(b, g) for g in grams) / n * (n / (n + 10)) for b in range(bits)]

    size, right = [0.0] * bits, [0] * bits
    for t, k in train:
        for b, z in enumerate(margin(t)):
            size[b] += abs(z)
            right[b] += z * codes[languages.index(k)][b] > 0
    scale = [4 / max(x / len(train), 1e-9) for x in size]
    trust = [max(x / len(train) - 0.5, 0.01) for x in right]
    trust = [x / (sum(trust) / bits) for x in trust]
    out = []
    for _, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
            continue
        loss = [sum(w * math.log1p(math.exp(-c * z * s)) for w, c, z, s in zip(trust, code, margin(t), scale, strict=True)) for code in codes]
        odds = [math.exp(min(loss) - x) for x in loss]
        out.append((languages[loss.index(min(loss))], max(odds) / sum(odds)))
    return out


def test_language_id_equals_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.where("doc_id < 160 AND length(text) < 4000").collect()]
    rows += [(7001, None, "en"), (7002, "", "de"), (7003, "12 %", "fr"), (None, "les maisons", "fr"), (7005, "das Haus", " "), (7006, "Über Äpfel " * 9000, "de"), (7006, "Über Äpfel " * 9000, "de"), (7006, "the", "en")]
    df = spark.createDataFrame([(*r, True, "x") for r in rows], "doc_id long, text string, lang string, held_out boolean, lang_pred string")
    got = sorted(((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in language_id.identify(df).collect()))
    want = sorted((str(d), k, s) for (d, _, _), (k, s) in zip(rows, brute_languages(rows), strict=True))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-4)


def test_long_texts_are_learned_from(spark):
    rows = [(i, "der Baum und das Haus stehen am Fluss " * 2500, "de") for i in range(30)] + [(100 + i, "the tree and the house stand by the river", "en") for i in range(30)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] < 100} == {"de"} and {r["lang_pred"] for r in got if r["doc_id"] >= 100} == {"en"}


def test_one_language_and_many_languages(spark):
    one = language_id.identify(spark.createDataFrame([(0, "hallo", "de"), (2, "hello", None), (3, "12", "de")], "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in one} == {0: ("de", 1.0), 2: ("de", 1.0), 3: ("und", 0.0)}
    rows = [(100 * k + i, "".join(chr(97 + (k * 7 + j * (k + 1)) % 26) for j in range(40)), f"l{k:02}") for k in range(30) for i in range(30 if k < 20 else 3)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=20)
    assert model.languages == [f"l{k:02}" for k in range(20)]


def brute_bag(text):
    x = [32 if c in " \t\n\v\f\r" else ord(c) for c in text or ""]
    out, words, word = Counter(), [], []
    for c in [*x, 32]:
        if c != 32:
            word.append(c)
        elif word:
            words.append(tuple(word))
            word = []
    for i, w in enumerate(words):
        h = (sum((c + 1) * pow(ngrams.BASE, k, 1 << 64) for k, c in enumerate(w)) & MASK) + len(w)
        h = int(ngrams.mix(np.array([h & MASK], np.uint64))[0])
        out[quality.AGAIN if i and words[i - 1] == w else (h >> 48) + 2 * quality.BUCKETS] += 1
    for n, factors, odd, base in ((3, (1, 0x1003F, 0x27D4EB2F), 0x85EBCA6B, 0), (4, (1, 0x1003F, 0x27D4EB2F, 0x165667B1), 0xC2B2AE35, quality.BUCKETS)):
        for i in range(len(x) - n + 1):
            own = x[i : i + n]
            if 32 not in own[1:-1]:
                out[(sum(c * f for c, f in zip(own, factors, strict=True)) * odd % (1 << 32) >> 16) + base] += 1
    return out


def brute_quality(rows, labels, seed=11):
    """Scores by the same descent, with lists and loops."""
    best = {}
    for d, q in labels:
        if d is not None and q in (0, 1) and crc(d) % 5:
            best[d] = max(q, best.get(d, 0))
    text_of = {d: t for d, t in rows if t is not None}
    train = [(brute_bag(text_of[d]), q) for d, q in sorted(best.items()) if d in text_of]
    rng = np.random.default_rng(seed)
    start = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.VOID + 1, quality.DIM)).astype(np.float32)
    vec, layer = {}, [[0.0, 0.0] for _ in range(quality.DIM)]
    row = lambda f: vec.setdefault(f, start[f].astype(float).tolist())
    good = sum(q for _, q in train) / len(train)
    bias = [math.log(1 - good), math.log(good)]

    def hidden(bag):
        n = max(1, sum(bag.values()))
        return [sum(k / n * row(f)[j] for f, k in bag.items()) for j in range(quality.DIM)]

    step, steps = 0, quality.EPOCHS * len(train)
    for _ in range(quality.EPOCHS):
        for i in rng.permutation(len(train)):
            bag, q = train[i]
            rate = quality.RATE * (1 - step / steps)
            h = hidden(bag)
            z = [sum(h[j] * layer[j][c] for j in range(quality.DIM)) + bias[c] for c in (0, 1)]
            p = [math.exp(x) / (math.exp(z[0]) + math.exp(z[1])) for x in z]
            p[q] -= 1
            back = [sum(layer[j][c] * p[c] for c in (0, 1)) for j in range(quality.DIM)]
            layer = [[layer[j][c] - rate * h[j] * p[c] for c in (0, 1)] for j in range(quality.DIM)]
            bias = [bias[c] - rate * 0.1 * p[c] for c in (0, 1)]
            n = max(1, sum(bag.values()))
            for f, k in bag.items():
                vec[f] = [x - rate * 20 * k / n * b for x, b in zip(row(f), back, strict=True)]
            step += 1
    out = []
    for d, t in rows:
        h = hidden(brute_bag(t))
        z = [sum(h[j] * layer[j][c] for j in range(quality.DIM)) + bias[c] for c in (0, 1)]
        out.append((d, 1 / (1 + math.exp(z[0] - z[1]))))
    return out


def test_quality_equals_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(quality, "RATE", 4.0)  # few rows: learns faster
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 0 OR doc_id % 6 = 0").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.where("length(text) < 900").collect()] + [(9001, None), (9002, ""), (9003, "日本語 日本語 テキスト ok ok"), (9004, " x\ty  ")]
    labels += [(9003, 0), (9003, 1), (9001, 1), (None, 1), (9004, None)]
    a = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, score double, predicted int")
    b = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, text string")
    got = sorted((r["doc_id"], r["score"], r["predicted"]) for r in quality.score(a, quality.learn(a, b)).collect())
    want = sorted(brute_quality(rows, labels))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-4)
    assert [g[2] for g in got] == [int(w[1] >= 0.3) for w in want]
    assert max(g[1] for g in got) - min(g[1] for g in got) > 0.01


def test_quality_learns_from_long_texts_and_repeated_ids(spark):
    rows = [(i, "bad!! words?? " * 6000) for i in range(1, 12)] + [(20 + i, "a calm line of prose") for i in range(12)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d >= 20)) for d, _ in rows], "doc_id long, quality int")
    got = quality.score(docs, quality.learn(docs, labels)).collect()
    assert all((r["score"] > 0.5) == (r["doc_id"] >= 20) for r in got) and len(got) == 69


def test_characters():
    texts = ["aé日😀z", "", "Ω", "ab"]
    code, at = ngrams.characters(*utf8(pa.array(texts)))
    assert ["".join(map(chr, code[a:b].tolist())) for a, b in zip(at, at[1:], strict=False)] == texts


def test_words_of_a_block():
    texts = ["ab cd", "", "  x", "x", "cd"]
    flat, at = utf8(pa.array(texts))
    begin, end = runs(flat != 32, at)
    assert [bytes(flat[a:b]) for a, b in zip(begin, end, strict=True)] == [b"ab", b"cd", b"x", b"x", b"cd"]
    h = slice_hashes(flat, begin, end)
    assert h[1] == h[4] and h[2] == h[3] and len(set(h.tolist())) == 3
