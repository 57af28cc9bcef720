"""BM25: statistics, an inverted index as tables, and scores.

The index is one table of postings (doc_id, token, tf, dl) and one row of corpus statistics. Every posting carries its document's
length, so a query reads the postings of its terms and nothing else; keyword_index keeps them on disk.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

K1, B = 1.5, 0.75


def query_terms(query: str, stopwords: Iterable[str] | None = None) -> list[str]:
    """The different tokens of a query, in order."""
    found = re.findall("[一-鿿]", query) + re.findall(r"\w{2,}", re.sub("[一-鿿]", " ", query))
    stop = set(stopwords or ())
    return [t for t in dict.fromkeys(x.lower() for x in found) if t not in stop]


def postings(docs: DataFrame, id: str = "doc_id", text: str = "text", stopwords: Iterable[str] | None = None) -> DataFrame:
    """doc_id, token, tf, dl. Documents without a token have no row, and count nowhere."""
    rows = docs.select(F.col(id).alias("doc_id"), X.tokens(text, stopwords).alias("tokens")).withColumn("dl", F.size("tokens"))
    return rows.select("doc_id", "dl", F.explode("tokens").alias("token")).groupBy("doc_id", "token", "dl").agg(F.count("*").cast("int").alias("tf")).select("doc_id", "token", "tf", "dl")


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: n_docs, total_len, avg_len."""
    per_doc = index.groupBy("doc_id").agg(F.first("dl").alias("dl"))
    return per_doc.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len")).withColumn("avg_len", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")).otherwise(0.0))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, dl: Column, avg: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b) + F.when(avg > 0, k1 * b / avg * dl).otherwise(0.0))


def score_index(index: DataFrame, stats: DataFrame, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """doc_id, score of the documents that hold a term. stats: corpus_stats of the whole corpus, whatever index was filtered by."""
    hits = index.where(F.col("token").isin(terms) if terms else F.lit(False))
    # as many rows as the query has terms, and one row: both are broadcast
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    joined = hits.join(F.broadcast(df), "token").join(F.broadcast(stats.select("n_docs", "avg_len")))
    return joined.groupBy("doc_id").agg(F.sum(idf(F.col("n_docs"), F.col("df")) * weight(F.col("tf"), F.col("dl"), F.col("avg_len"), k1, b)).alias("score"))


def score_texts(docs: DataFrame, query: str, id: str = "doc_id", text: str = "text", keep: Iterable[str] = (), stopwords: Iterable[str] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """doc_id, score and kept columns, straight from texts: one pass for the statistics and one for the scores, and nothing is
    shuffled but the statistics' single row. For many queries over one corpus, build postings."""
    terms = query_terms(query, stopwords)
    rows = docs.select(F.col(id).alias("doc_id"), *keep, X.tokens(text, stopwords).alias("tokens"))
    own = rows.select("doc_id", *keep, F.size("tokens").alias("dl"), *[occurrences("tokens", w).alias(f"tf{i}") for i, w in enumerate(terms)])
    # a filter on dl would be pushed below and tokenize once more
    some = F.when(F.col("dl") > 0, F.col("dl"))
    stats = own.agg(F.count(some).alias("n"), F.coalesce(F.avg(some), F.lit(0.0)).alias("avg"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))])
    total: Column = F.lit(0.0)
    for i in range(len(terms)):
        part = idf(F.col("n"), F.col(f"df{i}")) * weight(F.col(f"tf{i}"), F.col("dl"), F.col("avg"), k1, b)
        total = total + F.when(F.col(f"tf{i}") > 0, part).otherwise(0.0)
    return own.join(F.broadcast(stats)).select("doc_id", *keep, total.alias("score"))


def occurrences(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def top_k(scores: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best positive scores, ties by the given columns."""
    return scores.where("score > 0").orderBy(F.desc("score"), *(ties or ("doc_id",))).limit(max(0, k))


# -- keeping an index --------------------------------------------------------


def without_docs(index: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The index without some documents (doc_id); what had been deleted leaves no trace in later statistics."""
    return index.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def with_docs(index: DataFrame, docs: DataFrame, id: str = "doc_id", text: str = "text", stopwords: Iterable[str] | None = None) -> DataFrame:
    """The index with documents added, or put in the place of those with equal ids."""
    new = postings(docs, id, text, stopwords)
    return without_docs(index, docs.select(F.col(id).alias("doc_id"))).unionByName(new)


def indexable(docs: DataFrame, text: str = "text", stopwords: Iterable[str] | None = None) -> DataFrame:
    return docs.where(F.size(X.tokens(text, stopwords)) > 0)


def ranked(scores: DataFrame, *ties: str) -> DataFrame:
    """rank from 1. For lists that a limit has already bounded: their rows meet in one task."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *ties)))
