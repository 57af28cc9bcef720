"""The link graph: one table of links (source_path, target_path, target_anchor, idx), one of nodes (path, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .lineage import kept

SCOPES = ("all", "real", "virtual")
DIRECTIONS = {"out": "forward", "forward": "forward", "outlinks": "forward", "in": "backward", "backward": "backward", "inlinks": "backward", "both": "both"}
BUCKETS = ("wiki", "personal", "procedure")


def extract_links(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Each text's links, in order, without repetition."""
    return texts.select(F.col(path).alias("source_path"), F.posexplode(X.wikilinks(text)).alias("idx", "link")).select("source_path", F.col("link.target").alias("target_path"), F.col("link.anchor").alias("target_anchor"), "idx")


def links_of_nodes(nodes: DataFrame) -> DataFrame:
    """Links from the nodes' own arrays."""
    return nodes.select(F.col("path").alias("source_path"), F.posexplode("links").alias("idx", "link")).where("link.target_path <> ''").select("source_path", "link.target_path", "link.target_anchor", "idx")


def scoped(links: DataFrame, nodes: DataFrame, scope: str = "all") -> DataFrame:
    """Links to nodes that are there (real), that aren't (virtual), or all."""
    if scope not in SCOPES:
        raise ValueError(f"scope is one of {SCOPES}, not {scope!r}")
    if scope == "all":
        return links
    known = nodes.select(F.col("path").alias("target_path")).distinct()
    return links.join(known, "target_path", "left_semi" if scope == "real" else "left_anti").select(*links.columns)


def outlinks(links: DataFrame, nodes: DataFrame, path: str, scope: str = "all") -> DataFrame:
    return scoped(links.where(F.col("source_path") == path), nodes, scope).orderBy("idx")


def inlinks(links: DataFrame, nodes: DataFrame, path: str, scope: str = "all") -> DataFrame:
    return scoped(links.where(F.col("target_path") == path), nodes, scope).orderBy("source_path", "idx")


def inbound_sources(links: DataFrame, path: str) -> DataFrame:
    return links.where(F.col("target_path") == path).select("source_path").distinct()


def counts(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: real nodes, virtual ones (targets that aren't nodes), links."""
    virtual = links.select(F.col("target_path").alias("path")).distinct().join(nodes.select("path"), "path", "left_anti").agg(F.count("*").alias("virtual"))
    return nodes.agg(F.count("*").alias("real")).join(virtual).join(links.agg(F.count("*").alias("edges")))


def neighbours(links: DataFrame, path: str, neighbour: str, cap: int) -> DataFrame:
    """path, neighbour, nth, anchors of each path's first `cap` neighbours, in the order of their first link; of a direction given by
    the names of its columns."""
    order = "idx" if path == "source_path" else "source_path"
    grouped = links.groupBy(path, neighbour).agg(F.min(F.struct(order, "idx")).alias("first"), F.transform(F.array_sort(F.collect_list(F.when(F.length("target_anchor") > 0, F.struct("idx", "target_anchor")))), lambda a: a["target_anchor"]).alias("anchors"))
    nth = F.row_number().over(Window.partitionBy(path).orderBy("first", neighbour))
    return grouped.withColumn("nth", nth).where(F.col("nth") <= cap).select(F.col(path).alias("path"), F.col(neighbour).alias("neighbour"), "nth", "anchors")


def expand(paths: DataFrame, links: DataFrame, nodes: DataFrame, cap: int = 10) -> DataFrame:
    """path, direction, nth, neighbour, name, description, anchors for given paths (path): the cap comes before the nodes are looked up."""
    asked = paths.select("path").distinct()
    out = neighbours(links.join(asked.withColumnRenamed("path", "source_path"), "source_path", "left_semi"), "source_path", "target_path", cap).withColumn("direction", F.lit("outlinks"))
    back = neighbours(links.join(asked.withColumnRenamed("path", "target_path"), "target_path", "left_semi"), "target_path", "source_path", cap).withColumn("direction", F.lit("inlinks"))
    meta = nodes.select(F.col("path").alias("neighbour"), "name", "description")
    return out.unionByName(back).join(meta, "neighbour", "left").select("path", "direction", "nth", "neighbour", "name", "description", "anchors")


def render_expansion(expanded: DataFrame) -> DataFrame:
    """path, lines: the neighbours of expand() as indented text, those that it links to first."""
    said = lambda field: F.when(F.length(field) > 0, F.concat(F.lit(f'{field}="'), field, F.lit('"')))
    meta = F.concat_ws("  ", said("name"), said("description"))
    head = F.concat(F.lit("    "), F.when(F.col("direction") == "outlinks", "→").otherwise("←"), F.lit(" "), "neighbour", F.lit("  "), F.when(meta == "", "(no meta)").otherwise(meta))
    block = F.array_join(F.concat(F.array(head), F.transform("anchors", lambda a: F.concat(F.lit("          via anchor=#"), a))), "\n")
    sides = expanded.withColumn("block", block).groupBy("path", "direction").agg(F.array_sort(F.collect_list(F.struct("nth", "block"))).alias("items"))
    side = F.concat(F.lit("  "), "direction", F.lit(" ("), F.size("items").cast("string"), F.lit("):\n"), F.array_join("items.block", "\n"))
    return sides.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("direction") == "outlinks", 0).otherwise(1).alias("o"), side.alias("t")))), lambda x: x["t"]), "\n").alias("lines"))


def adjacency(links: DataFrame, direction: str = "both") -> DataFrame:
    """here, there and the link itself, for each way that it may be walked."""
    own = links.where("target_path <> ''").select("source_path", "target_path", "target_anchor").distinct()
    ahead = own.select(F.col("source_path").alias("here"), F.col("target_path").alias("there"), "source_path", "target_path", "target_anchor")
    back = own.select(F.col("target_path").alias("here"), F.col("source_path").alias("there"), "source_path", "target_path", "target_anchor")
    way = DIRECTIONS.get(direction)
    if way is None:
        raise ValueError(f"direction is one of {sorted(DIRECTIONS)}, not {direction!r}")
    return ahead if way == "forward" else back if way == "backward" else ahead.unionByName(back)


def traverse(links: DataFrame, nodes: DataFrame, seeds: list[str], depth: int = 1, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes (path, depth, name, description, indexed) and links (with the depth at which they were first walked) within `depth` steps of
    the seeds. One join for each step: the front with the links; nodes at the last depth aren't walked from. Each step's result is kept
    where later steps read it."""
    spark: SparkSession = links.sparkSession
    ways = adjacency(links, direction)
    seen = spark.createDataFrame([(s, 0) for s in dict.fromkeys(s for s in seeds if s)], "path string, depth int")
    front, walked = seen, None
    for step in range(1, max(0, depth) + 1):
        edges = kept(ways.join(front.select(F.col("path").alias("here")), "here"))
        new = edges.select("source_path", "target_path", "target_anchor").distinct().withColumn("depth", F.lit(step))
        walked = new if walked is None else walked.unionByName(new)
        front = kept(edges.select(F.col("there").alias("path")).distinct().join(seen.select("path"), "path", "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.unionByName(front)
    if walked is None:
        walked = spark.createDataFrame([], "source_path string, target_path string, target_anchor string, depth int")
    walked = walked.groupBy("source_path", "target_path", "target_anchor").agg(F.min("depth").alias("depth"))
    meta = nodes.select("path", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description"), F.lit(True).alias("indexed"))
    found = seen.join(meta, "path", "left").select("path", "depth", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("indexed", F.lit(False)).alias("indexed"))
    return found.orderBy("depth", "path"), walked.orderBy("depth", "source_path", "target_path", F.coalesce("target_anchor", F.lit("")))


def snapshot(nodes: DataFrame, links: DataFrame, digest: str = "digest", daily: str = "daily") -> tuple[DataFrame, DataFrame]:
    """Three category roots, the digest notes under them, and the daily notes that these link to. Returns nodes (id, path, name,
    description, indexed, virtual) and links (source, target, target_anchor)."""
    spark = nodes.sparkSession
    category = F.regexp_extract("path", rf"^{X.literal(digest)}/({'|'.join(BUCKETS)})/", 1)
    notes = nodes.where(F.lower("path").endswith(".md")).withColumn("category", category)
    digests = notes.where("category <> ''")
    targets = digests.select("path").unionByName(notes.where(F.col("path").startswith(daily + "/")).select("path")).distinct()
    own = links.join(digests.select(F.col("path").alias("source_path")), "source_path", "left_semi").join(targets.withColumnRenamed("path", "target_path"), "target_path", "left_semi")
    edges = own.select(F.col("source_path").alias("source"), F.col("target_path").alias("target"), "target_anchor").distinct()
    roots = spark.createDataFrame([(f"virtual:{b}", f"{digest}/{b}", b, "", False, True) for b in BUCKETS], "id string, path string, name string, description string, indexed boolean, virtual boolean")
    leaves = edges.where(F.col("target").startswith(daily + "/")).select(F.col("target").alias("path")).distinct()
    shown = notes.join(digests.select("path").unionByName(leaves).distinct(), "path", "left_semi")
    shown = shown.select(F.col("path").alias("id"), "path", "name", "description", F.lit(True).alias("indexed"), F.lit(False).alias("virtual"))
    stems = digests.select(F.concat(F.lit("virtual:"), "category").alias("source"), F.col("path").alias("target"), F.lit(None).cast("string").alias("target_anchor"))
    return roots.unionByName(shown), edges.unionByName(stems)
