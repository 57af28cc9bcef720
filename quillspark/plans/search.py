"""Retrieval: hybrid, keyword, vector and node search over chunks.

chunks: id, path, start_line, end_line, text, embedding, metadata. Each branch ranks what the filter lets through and keeps a bounded list of
candidates; fusion works on ranks within these lists. BM25's statistics are those of all chunks, whatever the filter.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bm25, filters, fusion, graph, intervals, vector
from ..operators.keyword_index import KeywordIndex
from ..sources.files import is_session

MOST, FACTOR, PLAIN_FACTOR, WEIGHT = 200, 5.0, 10, 0.7
COLUMNS = ("path", "start_line", "end_line", "text")


def default_limit(name: str = "QUILLSPARK_SEARCH_LIMIT") -> int:
    try:
        return int(os.environ[name])
    except (KeyError, ValueError):
        return 5


def candidates(limit: int, factor: float = FACTOR) -> int:
    return min(MOST, max(1, int(limit * factor)))


def checked(query: str, limit: int | None) -> tuple[str, int]:
    query = (query or "").strip()
    if not query:
        raise ValueError("query cannot be empty")
    limit = default_limit() if limit is None else int(limit)
    if limit <= 0:
        raise ValueError(f"limit must be positive, not {limit}")
    return query, limit


def weight_of(value: object) -> float:
    try:
        return max(0.0, min(1.0, float(value)))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return WEIGHT


def keyword_branch(chunks: DataFrame, query: str, k: int, where: Column | None, stopwords: Sequence[str] | None = None, index: KeywordIndex | None = None) -> DataFrame:
    """id, columns, score, rank of what `where` lets through (None: all). index: a kept index of the chunks by their ids; without one all texts
    are read."""
    if index is not None:
        scores = index.scores(query).withColumnRenamed("doc_id", "id").where("score > 0")
        own = scores.join(chunks.where(where).select("id"), "id", "left_semi") if where is not None else scores
        best = bm25.top_k(own, k, "id")  # k rows at most, so they are broadcast
        return bm25.ranked(chunks.select("id", *COLUMNS).join(F.broadcast(best), "id").select("id", *COLUMNS, "score"), "id")
    scored = bm25.score_texts(chunks.withColumn("_keep", F.lit(True) if where is None else where), query, "id", "text", [*COLUMNS, "_keep"], stopwords)
    best = bm25.top_k(scored.where("_keep").drop("_keep").withColumnRenamed("doc_id", "id"), k, "id")
    return bm25.ranked(best, "id")


def vector_branch(chunks: DataFrame, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
    best = vector.top_k((chunks if where is None else chunks.where(where)).select("id", *COLUMNS, "embedding"), query, k, "id")
    return bm25.ranked(best, "id")


def hybrid(chunks: DataFrame, query: str, query_vector: Sequence[float] | None, limit: int | None = None, min_score: float = 0.0, vector_weight: object = WEIGHT, search_filter: Mapping | None = None, start_date: object = None, end_date: object = None, strict_date_filter: bool = False, seen: DataFrame | None = None, factor: float = FACTOR, stopwords: Sequence[str] | None = None, always_both: bool = False, keep: int | None = None, index: KeywordIndex | None = None) -> DataFrame:
    """rank, id, path, start_line, end_line, text, score, vector, keyword of the best chunks. With a weight of 0 or 1 one branch isn't run, and scores
    are the other's own; min_score holds for whatever the score is. seen: ids (id) that were returned before. keep: rows to return if not `limit`, which still
    sets the number of candidates."""
    query, limit = checked(query, limit)
    w = weight_of(vector_weight)
    asked = filters.normalized(search_filter, start_date, end_date, strict_date_filter)
    where = filters.predicate(asked) if asked else None
    k = candidates(limit, factor)
    use_vector, use_keyword = query_vector is not None and (always_both or w > 0), always_both or w < 1 or query_vector is None
    v = vector_branch(chunks, query_vector, k, where) if use_vector else None
    t = keyword_branch(chunks, query, k, where, stopwords, index) if use_keyword else None
    if v is not None and t is not None:
        fused = both_or_one(v, t, w)
    else:
        one, name = (v, "vector") if v is not None else (t, "keyword")
        other = "keyword" if name == "vector" else "vector"
        fused = one.select("id", *COLUMNS, "score", F.col("score").alias(name), F.lit(None).cast("double").alias(other), F.col("rank").alias("vector_rank"), F.lit(None).cast("int").alias("keyword_rank"))
    if min_score > 0:
        fused = fused.where(F.col("score") >= min_score)
    if seen is not None:
        fused = fused.join(seen.select("id").distinct(), "id", "left_anti")
    best = fused.orderBy(*fusion.fused_order()).limit(limit if keep is None else keep)
    rank = F.row_number().over(Window.orderBy(*fusion.fused_order()))
    return best.withColumn("rank", rank).select("rank", "id", *COLUMNS, "score", "vector", "keyword")


def both_or_one(v: DataFrame, t: DataFrame, w: float) -> DataFrame:
    """Fused by rank; where one of the lists has no hit at all, the other with its own scores. Each list is read once: they are bounded, and meet
    in one task."""
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    a = v.select("id", *COLUMNS, F.col("score").alias("vector"), F.col("rank").alias("vector_rank"), *none("double", "keyword"), *none("int", "keyword_rank"))
    b = t.select("id", *COLUMNS, *none("double", "vector"), *none("int", "vector_rank"), F.col("score").alias("keyword"), F.col("rank").alias("keyword_rank"))
    one = a.unionByName(b).groupBy("id").agg(*[F.first(c).alias(c) for c in COLUMNS], *[F.max(c).alias(c) for c in ("vector", "vector_rank", "keyword", "keyword_rank")])
    all_rows = Window.partitionBy()
    counted = one.withColumn("nv", F.count("vector").over(all_rows)).withColumn("nt", F.count("keyword").over(all_rows))
    score = F.when(F.col("nt") == 0, F.col("vector")).when(F.col("nv") == 0, F.col("keyword")).otherwise(fusion.reciprocal(w))
    return counted.withColumn("score", score).drop("nv", "nt")


def keyword(chunks: DataFrame, query: str, limit: int | None = None, min_score: float = 0.0, seen: DataFrame | None = None, stopwords: Sequence[str] | None = None, index: KeywordIndex | None = None) -> DataFrame:
    query, limit = checked(query, limit)
    return plain(keyword_branch(chunks, query, candidates(limit, PLAIN_FACTOR), None, stopwords, index), limit, min_score, seen)


def nearest(chunks: DataFrame, query_vector: Sequence[float], limit: int | None = None, min_score: float = 0.0, seen: DataFrame | None = None) -> DataFrame:
    _, limit = checked("-", limit)
    return plain(vector_branch(chunks, query_vector, candidates(limit, PLAIN_FACTOR)), limit, min_score, seen)


def plain(found: DataFrame, limit: int, min_score: float, seen: DataFrame | None) -> DataFrame:
    if min_score > 0:
        found = found.where(F.col("score") >= min_score)
    if seen is not None:
        found = found.join(seen.select("id").distinct(), "id", "left_anti")
    return found.orderBy("rank").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy("rank"))).select("rank", "id", *COLUMNS, "score")


def nodes(chunks: DataFrame, node_table: DataFrame, query: str, query_vector: Sequence[float], limit: int = 20, vector_weight: float = WEIGHT, digest: str = "digest", factor: float = FACTOR, stopwords: Sequence[str] | None = None) -> DataFrame:
    """path, score, name, description of digest notes. The layer's filter comes after the candidates' limit, each list has one row per note and is
    ranked anew, and then the lists are fused."""
    query, limit = checked(query, limit)
    k = candidates(limit, factor)
    own = lambda found: fusion.first_per(found.where(X.under("path", digest)).select("path", "rank"), "path")
    fused = fusion.fuse_nodes(own(vector_branch(chunks, query_vector, k)), own(keyword_branch(chunks, query, k, None, stopwords)), vector_weight)
    best = fused.orderBy(F.desc("score"), "path").limit(limit)
    return best.join(node_table.select("path", "name", "description"), "path", "left").select("path", F.round("score", 4).alias("score"), F.trim(F.coalesce("name", F.lit(""))).alias("name"), F.trim(F.coalesce("description", F.lit(""))).alias("description"))


def passages(chunks: DataFrame, query: str, query_vector: Sequence[float] | None, limit: int | None = None, seen_ranges: DataFrame | None = None, session_dir: str = "session/dialog", compress: Callable[[Column], Column] | None = None, **options: object) -> DataFrame:
    """place, path, start_line, end_line, text, score: hybrid search whose results aren't covered by ranges that were returned before (path, start_line,
    end_line), with transcripts' overlapping passages joined. compress: a column function; its result is taken where it is shorter and not empty."""
    query, limit = checked(query, limit)
    found = hybrid(chunks, query, query_vector, limit, always_both=query_vector is not None, keep=None if seen_ranges is None else 2 * MOST, **options)  # type: ignore[arg-type]
    if seen_ranges is not None:
        found = intervals.uncovered(found, seen_ranges, "path").orderBy("rank").limit(limit)
    talk = is_session("path", session_dir)
    rows = found.select("path", "start_line", "end_line", "text", "score", "rank", F.min("rank").over(Window.partitionBy("path")).alias("path_rank"), F.when(talk, "").otherwise(F.col("id")).alias("own"))
    joined = intervals.union_passages(rows, "path", "own")
    if compress:
        short = compress(F.col("text"))
        joined = joined.withColumn("text", F.when((F.length(F.trim(short)) > 0) & (F.length(short) <= F.length("text")), short).otherwise(F.col("text")))
    return joined.withColumn("place", F.row_number().over(Window.orderBy("path_rank", "start_line"))).select("place", "path", "start_line", "end_line", "text", "score")


def answer(found: DataFrame, links: DataFrame | None = None, node_table: DataFrame | None = None, cap: int = 10, place: str = "rank") -> DataFrame:
    """One row: the results as text, each under a head line, with its neighbours where links are given."""
    head = F.concat(F.lit("========== "), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(" [score="), F.format_string("%.4f", F.col("score")), F.lit("] ==========\n"), "text")
    rows = found.select(place, "path", head.alias("block"))
    if links is not None and node_table is not None:
        rows = rows.join(graph.render_expansion(graph.expand(rows, links, node_table, cap)), "path", "left").withColumn("block", F.concat_ws("\n", "block", "lines"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "block"))), lambda x: x["block"]), "\n").alias("answer"))


def read(texts: DataFrame, links: DataFrame, node_table: DataFrame, start: int = 1, end: int | None = None, cap: int = 10) -> DataFrame:
    """path, answer: lines start to end of notes (path, text), and under them their neighbours."""
    own = X.lines("text")
    part = F.slice(own, F.lit(max(1, start)), F.greatest(F.lit(0), (F.size(own) if end is None else F.lit(end)) - max(1, start) + 1))
    rows = texts.select("path", F.array_join(part, "\n").alias("part"))
    around = graph.render_expansion(graph.expand(rows.select("path"), links, node_table, cap))
    return rows.join(around, "path", "left").select("path", F.concat_ws("\n", "part", "lines").alias("answer"))
