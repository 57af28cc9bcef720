"""Ranked lists of papers, and news windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pages import plain_text

ID = r"^\d{4}\.\d{4,5}$"


def paper_of(payload: Column) -> Column:
    """A paper from a JSON item whose fields lie in `paper` or at the top: null without a well-formed id."""
    at = lambda name: F.coalesce(F.get_json_object(payload, f"$.paper.{name}"), F.get_json_object(payload, f"$.{name}"))
    id_ = F.regexp_replace(F.trim(at("id")), r"v\d+$", "")
    fields = F.struct(id_.alias("arxiv_id"), at("title").alias("title"), at("summary").alias("summary"), F.coalesce(at("upvotes").cast("int"), F.lit(0)).alias("upvotes"))
    return F.when(id_.rlike(ID), fields)


def ids_in_page(html: Column) -> Column:
    """Paper ids in the order in which a page links to them, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="/papers/(\d{4}\.\d{4,5})"')))


def ordered_metadata(ids: DataFrame, papers: DataFrame) -> DataFrame:
    """ids (arxiv_id, rank) with what is known about them; the page's order holds."""
    return ids.join(papers.dropDuplicates(["arxiv_id"]), "arxiv_id", "left")


def merge_lists(monthly: DataFrame, weekly: DataFrame, id: str = "arxiv_id") -> DataFrame:
    """Papers of two ranked lists: most upvotes, the first text that isn't empty (monthly first), each list's own rank."""
    texts = [c for c in monthly.columns if c not in (id, "rank", "upvotes")]
    named = lambda df, p: df.select(F.col(id).alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{c}") for c in [*texts, "rank", "upvotes"]])
    both = named(monthly, "m").join(named(weekly, "w"), F.col("m_id") == F.col("w_id"), "full_outer")
    first = lambda c: F.coalesce(F.nullif(F.col(f"m_{c}"), F.lit("")), F.col(f"w_{c}"), F.col(f"m_{c}")).alias(c)
    return both.select(F.coalesce("m_id", "w_id").alias(id), *[first(c) for c in texts], F.greatest(F.coalesce("m_upvotes", F.lit(0)), F.coalesce("w_upvotes", F.lit(0))).alias("upvotes"), F.col("m_rank").alias("monthly_rank"), F.col("w_rank").alias("weekly_rank"))


def fused_score(monthly: Column, weekly: Column, k: int = 60, weekly_weight: float = 0.7) -> Column:
    part = lambda rank, w: F.coalesce(F.lit(w) / (F.lit(k) + rank), F.lit(0.0))
    return part(monthly, 1.0) + part(weekly, weekly_weight)


def candidates(papers: DataFrame, *excluded: DataFrame, limit: int = 20, id: str = "arxiv_id") -> DataFrame:
    """The best papers by fused rank that no excluded list (id) has."""
    for gone in excluded:
        papers = papers.join(gone.select(id).distinct(), id, "left_anti")
    return papers.withColumn("fused_score", fused_score(F.col("monthly_rank"), F.col("weekly_rank"))).orderBy(F.desc("fused_score"), F.desc("upvotes"), id).limit(limit)


def news_window(rows: DataFrame, start: Column, end: Column, id: str = "news_id", at: str = "event_time", order: str = "page_order") -> DataFrame:
    """News in the window, both ends included, with a title or content; of equal ids the first that came."""
    inside = rows.where(F.col(at).between(start, end) & ((F.length(F.coalesce("title", F.lit(""))) > 0) | (F.length(F.coalesce("content", F.lit(""))) > 0)))
    first = inside.withColumn("nth", F.row_number().over(Window.partitionBy(id).orderBy(order))).where("nth = 1").drop("nth")
    return first.orderBy(at, id)


def news_rows(raw: DataFrame) -> DataFrame:
    """news_id, event_time, title, content, page_order of raw items (id, ctime, title, brief, content, page_order)."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))
    rows = raw.where(F.col("id").cast("string").rlike(r"^\d+$") & F.col("ctime").cast("string").rlike(r"^\d+$"))
    return rows.select(F.col("id").cast("long").cast("string").alias("news_id"), F.timestamp_seconds(F.col("ctime").cast("long")).alias("event_time"), plain_text(pick("title", "brief", "content")).alias("title"), plain_text(pick("content", "brief")).alias("content"), "page_order")


def numbered_batches(rows: DataFrame, size: int = 50, *order: str, text: str = "text", most_chars: int = 1000, part: Column | None = None) -> DataFrame:
    """rows with `batch`: consecutive ones of `size` rows; texts cut to most_chars. part: a column that rises with the order (a day of a time);
    parts are numbered by themselves, after the rows of all parts before them, so no task sees more than one part."""
    own = rows.withColumn("_part", F.lit(0) if part is None else part)
    counts = own.groupBy("_part").agg(F.count("*").alias("n"))  # a row for each part
    before = counts.select("_part", (F.sum("n").over(Window.orderBy(F.asc_nulls_first("_part"))) - F.col("n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_before")
    numbered = own.alias("r").join(F.broadcast(before).alias("b"), F.col("r._part").eqNullSafe(F.col("b._part"))).select("r.*", "_before")
    return numbered.withColumn("batch", F.floor(nth / size).cast("int")).withColumn(text, F.left(text, F.lit(most_chars))).drop("_part", "_before")


def date_spine(events: DataFrame, at: str, counted: str = "n") -> DataFrame:
    """day, n of every day from the first event to the last, days without events included."""
    days = events.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias(counted))
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(days, "day", "left").select("day", F.coalesce(counted, F.lit(0)).alias(counted))
