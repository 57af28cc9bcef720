"""Quality classifier on supervised subword embeddings.

A document is the mean of learned vectors of its hashed words and of the character 3- and 4-grams of its words. Text that says a word over
and over is what published quality filters look for first (shares of repeated words and n-grams), and a mean of words can't show
it; so a word that equals the one before it has one vector of its own, whatever word it is. A softmax layer on top tells good from bad.
Vectors and layer are trained together by stochastic gradient descent in numpy.

Defined results: null and empty texts are scored as a document of no features (the layer's bias alone); without
labels of both classes every score is the share of label 1 (0.5 if there is none); a document with several labels
counts as good if any of them is; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, crc_mod, hashed_share, segment_sums, utf8
from .ngrams import characters, no_cross, runs, slice_hashes

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
BUCKETS = 1 << 16
VOID = 3 * BUCKETS + 1
#: Stands for any word that equals the one before it.
AGAIN = 3 * BUCKETS
DIM, EPOCHS, RATE = 8, 6, 0.4
#: Training documents of a class at most (in expectation).
PER_CLASS = 1200
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@dataclass
class Model:
    vectors: np.ndarray  # features x DIM
    layer: np.ndarray  # DIM x 2
    bias: np.ndarray


def features(flat: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the character 3- and of the 4-gram that begin at each character (VOID if it holds a blank other than at its ends, or
    leaves the text), and where texts begin among these; words' buckets, and where texts begin among them."""
    x, at = characters(flat, at)
    blank = BLANK[np.minimum(x, 255)]
    x[blank] = 32
    n = len(x)
    three, four = np.full(n, VOID, np.uint32), np.full(n, VOID, np.uint32)
    if n > 2:
        packed = x[:-2] + x[1:-1] * np.uint32(0x1003F) + x[2:] * np.uint32(0x27D4EB2F)
        three[:-2] = np.where(blank[1:-1], np.uint32(VOID), packed * np.uint32(0x85EBCA6B) >> np.uint32(16))
        if n > 3:
            packed = packed[:-1] + x[3:] * np.uint32(0x165667B1)
            four[:-3] = np.where(blank[1:-2] | blank[2:-1], np.uint32(VOID), (packed * np.uint32(0xC2B2AE35) >> np.uint32(16)) + np.uint32(BUCKETS))
    begin, end = runs(~blank, at)
    hashes, word_at = slice_hashes(x, begin, end), np.searchsorted(begin, at)
    words = (hashes >> np.uint64(48)).astype(np.uint32) + np.uint32(2 * BUCKETS)
    again = np.zeros(len(words), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[word_at[word_at < len(words)]] = False
    words[again] = AGAIN
    return [no_cross(three, at, 3, VOID), no_cross(four, at, 4, VOID)], at, words, word_at


def bags(flat: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's buckets, and how often it has them."""
    grams, gram_at, words, word_at = features(flat, at)
    out = []
    for k in range(len(at) - 1):
        own = [g[gram_at[k] : gram_at[k + 1]] for g in grams]
        out.append(np.unique(np.concatenate([words[word_at[k] : word_at[k + 1]], *(g[g != VOID] for g in own)]), return_counts=True))
    return out


def embed(flat: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    grams, gram_at, words, word_at = features(flat, at)
    total = segment_sums(vectors[words], word_at)
    count = np.diff(word_at).astype(np.float64)
    for g in grams:
        total += segment_sums(vectors[g], gram_at)
        count += segment_sums(g != VOID, gram_at)
    return total / np.maximum(count, 1)[:, None]


def probability(hidden: np.ndarray, model: Model) -> np.ndarray:
    z = hidden @ model.layer + model.bias
    return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -60, 60)))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 11) -> Model:
    """docs: bags of each document."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (VOID + 1, DIM)).astype(np.float32)
    vectors[VOID] = 0
    model = Model(vectors, np.zeros((DIM, 2)), np.zeros(2))
    good = float(np.mean(labels)) if labels else 0.5
    if good in (0.0, 1.0):
        model.bias = np.log(np.array([1 - good, good]) + 1e-3)
        return model
    if not labels:
        return model
    rows = [(index, n / max(1, n.sum())) for index, n in docs]
    model.bias = np.log(np.array([1 - good, good]))
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            index, share = rows[i]
            rate = RATE * (1 - step / steps)
            hidden = share @ vectors[index]
            z = hidden @ model.layer + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = model.layer @ p
            model.layer -= rate * np.outer(hidden, p)
            model.bias -= rate * 0.1 * p
            # a mean's gradient is spread over all features; words' vectors are few per text, so it is scaled up
            vectors[index] -= (rate * 20 * share[:, None] * back).astype(np.float32)
            step += 1
    return model


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """From labelled rows that aren't held out: of each class about per_class ids, chosen by a hash, with one text each (of an id with several
    texts that with the least hash), whole and whatever its length. Executors make the texts' features; at most 3 * BUCKETS counts for
    each document come to the driver."""
    known = labels.select(labels[doc_id].cast("long").alias("doc_id"), labels[label].cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [])
    chosen = F.lit(False)
    for k, n in sorted(counts.items()):
        chosen |= (F.col("label") == k) & hashed_share("doc_id", per_class / n)
    # about 2 * per_class rows of two numbers: a bound by construction
    picked = F.broadcast(known.where(chosen))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).where("text IS NOT NULL").join(picked, "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            own = bags(*utf8(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([i.tobytes() for i, _ in own], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in own], pa.binary())], names=["doc_id", "label", "buckets", "times"])

    found = sorted(map(tuple, rows.mapInArrow(run, "doc_id long, label int, buckets binary, times binary").collect()))
    return fit([(np.frombuffer(i, "<u4"), np.frombuffer(n, "<u4")) for _, _, i, n in found], [k for _, k, _, _ in found])


def score(docs: DataFrame, model: Model, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 5 is 0), score, predicted (score >= threshold); only the text decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            p = probability(embed(*utf8(part.column("text")), model.vectors), model)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.withColumn("held_out", crc_mod("doc_id", 5) == 0).mapInArrow(run, SCHEMA)
