"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. One binary classifier for each bit (log odds of hashed byte 2- and 3-grams)
tells how likely the bit is set; the codeword with the least loss, each bit weighted by how well its classifier
does on the training rows, gives the language. A small gap to the second best codeword marks a text as ambiguous.

Defined results: null texts and texts without a letter are `und` with score 0; null and blank languages aren't learned; if no labelled row
can be learned from, every text is `und`; with one language every text that has a letter is of it; repeated rows give repeated results; columns other than the id, the text and (for learning)
the language are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, crc_mod, cut, segment_sums, utf8
from .ngrams import lower_latin, no_cross

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
GRAMS = 1 << 16
VOID = 2 * GRAMS
#: bytes that count as parts of words: a-z and all of other scripts; the others are blanks.
WORD = np.where([(97 <= b <= 122) or b >= 128 for b in range(256)], np.arange(256), 32).astype(np.uint32)
#: Loss gap of the two nearest codewords under which a text is ambiguous.
AMBIGUOUS = 1.0
#: What the model is fitted on at most: rows of a language (in expectation), and languages (the most frequent ones, ties by name).
PER_LANGUAGE, LANGUAGES = 600, 256
#: Longer texts weigh as much in the counts as one of so many bytes. Bytes of sampled texts that one task counts, in expectation.
FULL_WEIGHT, TASK_BYTES = 1 << 16, 32 << 20


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # grams x bits
    scales: np.ndarray  # of the bits' mean log odds
    trust: np.ndarray  # of the bits in the loss


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """Up to seven classes: the exhaustive code. More: of 300 random dense codes that with the largest distance."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 7:
        columns = [c for c in product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).T
    rng = np.random.default_rng(seed)
    bits, best, most = 15 * int(np.ceil(np.log2(k))), None, -1
    for _ in range(300):
        code = rng.choice(np.array([-1, 1], np.int8), (k, bits))
        code = code[:, np.abs(code.sum(0)) < k]
        apart = (code.shape[1] - code.astype(np.int32) @ code.T.astype(np.int32)) // 2 + np.eye(k, dtype=np.int32) * bits
        if apart.min() > most:
            best, most = code, apart.min()
    return best


def gram_indices(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = WORD[lower_latin(flat)]
    n = len(x)
    two, three = np.full(n, VOID, np.uint32), np.full(n, VOID, np.uint32)
    if n > 1:
        two[:-1] = x[:-1] | x[1:] << np.uint32(8)
    if n > 2:
        three[:-2] = ((two[:-2] | x[2:] << np.uint32(16)) * np.uint32(0x9E3779B1) >> np.uint32(16)) + np.uint32(GRAMS)
    return no_cross(two, at, 2, VOID), no_cross(three, at, 3, VOID)


def has_letter(flat: np.ndarray, at: np.ndarray, texts: pa.Array) -> np.ndarray:
    low = flat | np.uint8(32)
    plain = segment_sums((low >= 97) & (low <= 122) & (flat < 128), at) > 0
    for i in np.flatnonzero(~plain & (segment_sums(flat >= 128, at) > 0)):
        plain[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return plain


def margins(flat: np.ndarray, at: np.ndarray, weights: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """texts x bits; little text gives small margins."""
    two, three = gram_indices(flat, at)
    n = np.maximum(np.diff(at), 1)[:, None]
    return segment_sums(weights[two] + weights[three], at) / n * scales * (n / (n + 10.0))


def losses(z: np.ndarray, model: Model) -> np.ndarray:
    """texts x languages: weighted logistic loss of the margins against each codeword."""
    right, wrong = np.logaddexp(0, -z) * model.trust, np.logaddexp(0, z) * model.trust
    set_ = (model.codes > 0).astype(np.float64)
    return right @ set_.T + wrong @ (1 - set_).T


def gram_counts() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's rows (text, of): how often a language has a gram. Rows (of, gram, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part in blocks(batches):
            flat, at = utf8(part.column("text"))
            size = np.diff(at)
            of, weight = np.repeat(part.column("of").to_numpy(), size), np.repeat(np.minimum(1, FULL_WEIGHT / np.maximum(size, 1)), size)
            for index in gram_indices(flat, at):
                for k in np.unique(of).tolist():
                    own = (of == k) & (index < VOID)
                    total[k] = total.get(k, 0) + np.bincount(index[own], weight[own], minlength=2 * GRAMS)
        for k, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["of", "gram", "n"])

    return run


def weighed(languages: list[str], share: np.ndarray) -> Model:
    """Classifiers from the grams' counts by language (languages x grams); their scales and trust are 1."""
    codes = codewords(len(languages))
    share = share / np.maximum(1, share.sum(1, keepdims=True)) + 1e-6
    weights = np.zeros((VOID + 1, codes.shape[1]), np.float32)
    for b in range(codes.shape[1] if len(languages) > 1 else 0):
        weights[:VOID, b] = np.log(share[codes[:, b] > 0].mean(0)) - np.log(share[codes[:, b] < 0].mean(0))
    return Model(languages, codes, weights, np.ones(codes.shape[1]), np.ones(codes.shape[1]))


def bit_sums(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's rows (text, of): by bit the margins' sizes, how many have the right sign, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = model.codes.shape[1]
        size, right, n = np.zeros(bits), np.zeros(bits), 0
        for part in blocks(batches):
            z = margins(*utf8(part.column("text")), model.weights, model.scales)
            size += np.abs(z).sum(0)
            right += (z * model.codes[part.column("of").to_numpy()] > 0).sum(0)
            n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(bits), pa.int32()), pa.array(size), pa.array(right), pa.array([n] * bits, pa.int64())], names=["bit", "size", "right", "n"])

    return run


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, most_languages: int = LANGUAGES) -> Model:
    """From rows with a language (not blank) that aren't held out: of each of the most frequent languages about per_language rows,
    chosen by a hash of id and text, whole and whatever their length. Executors read the texts; counts come to the driver, 2 * GRAMS for
    each language and fewer for each bit."""
    known = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"), docs[lang].cast("string").alias("lang"))
    known = known.where((F.trim("lang") != "") & F.col("text").isNotNull() & (crc_mod("doc_id", 3) != 1))
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("size")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not found:
        return Model([], codewords(0), np.zeros((VOID + 1, 1), np.float32), np.ones(1), np.ones(1))
    languages = sorted(r["lang"] for r in found)
    shares = [(r["lang"], languages.index(r["lang"]), min(1.0, per_language / r["n"]), r["size"]) for r in found]
    if len(languages) == 1:
        return weighed(languages, np.zeros((1, 2 * GRAMS)))
    # at most most_languages rows: a bound by construction
    of = F.broadcast(docs.sparkSession.createDataFrame([s[:3] for s in shares], "lang string, of int, share double"))
    picked = known.join(of, "lang").where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    sample = cut(picked.select("text", "of").repartition(max(1, round(sum(share * size for _, _, share, size in shares) / TASK_BYTES))))
    counted = sample.mapInArrow(gram_counts(), "of int, gram int, n double").groupBy("of", "gram").agg(F.sum("n").alias("n")).toArrow()
    share = np.zeros((len(languages), 2 * GRAMS))
    share[counted.column("of").to_numpy(), counted.column("gram").to_numpy()] = counted.column("n").to_numpy()
    model = weighed(languages, share)
    sums = sample.mapInArrow(bit_sums(model), "bit int, size double, right double, n long").groupBy("bit").agg(F.sum("size"), F.sum("right"), F.sum("n")).collect()
    for bit, size, right, n in sums:
        model.scales[bit] = 4 / max(size / max(1, n), 1e-9)
        model.trust[bit] = max(right / max(1, n) - 0.5, 0.01)
    model.trust /= model.trust.mean()
    return model


def decide(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the language's index (that after the last for `und`), whether it has one, score, ambiguous."""
    texts = column.fill_null("")
    flat, at = utf8(texts)
    n, k = len(at) - 1, len(model.languages)
    if not k:
        return np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n), np.zeros(n, bool)
    loss = losses(margins(flat, at, model.weights, model.scales), model)
    spoken = has_letter(flat, at, texts)
    odds = np.exp(loss.min(1, keepdims=True) - loss)
    two = np.partition(loss, 1, axis=1) if k > 1 else np.zeros((n, 0))
    unsure = spoken & (two[:, 1] - two[:, 0] < AMBIGUOUS) if k > 1 else np.zeros(n, bool)
    return np.where(spoken, loss.argmin(1), k), spoken, np.where(spoken, odds.max(1) / odds.sum(1), 0), unsure


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 3 is 1), lang_pred, score, ambiguous; only the text decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        for part in blocks(batches):
            best, _, score, unsure = decide(part.column("text"), model)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names[best], pa.string()), pa.array(score), pa.array(unsure)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.withColumn("held_out", crc_mod("doc_id", 3) == 1).mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language: not `und`, and not ambiguous with a score under `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, text):
            _, known, score, unsure = decide(part.column(text), model)
            yield part.filter(pa.array(known & ~(unsure & (score < least))))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))
