"""Tables that the registered queries share. What the driver's tables lack (paths, links, line ranges, snapshots) is derived from all their
rows by one SQL text that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Chunks of documents: one each, with a path whose second part may be a day.
CHUNKS = """SELECT doc_id, CAST(doc_id AS STRING) AS id, text, lang, source,
  concat(CASE doc_id % 4 WHEN 0 THEN 'digest/wiki/' WHEN 1 THEN 'digest/personal/' WHEN 2 THEN concat('daily/2024-01-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), '/') ELSE 'resource/' END, 'n', CAST(doc_id AS STRING), '.md') AS path,
  1 AS start_line, 10 AS end_line FROM documents"""

#: Notes as a graph: each customer links to two others, some of which aren't there; every third link has an anchor.
LINKS = """SELECT concat('n/', CAST(c_custkey AS STRING)) AS source_path, concat('n/', CAST(1 + (c_custkey * 7 + 3) % 1700 AS STRING)) AS target_path,
  CASE WHEN c_custkey % 3 = 0 THEN concat('L', CAST(c_custkey % 9 AS STRING)) END AS target_anchor, 0 AS idx FROM customer
  UNION ALL SELECT concat('n/', CAST(c_custkey AS STRING)), concat('n/', CAST(1 + (c_custkey * 13 + 5) % 150 AS STRING)), CAST(NULL AS STRING), 1 FROM customer"""
NODES = """SELECT concat('n/', CAST(c_custkey AS STRING)) AS path, c_name AS name, c_mktsegment AS description FROM customer"""

#: Line ranges: each turn of a conversation covers some lines.
RANGES = """SELECT concat('session/dialog/', CAST(conv_id AS STRING), '.jsonl') AS path, CAST(turn * 5 + conv_id % 3 AS INT) AS start_line,
  CAST(turn * 5 + conv_id % 3 + length(text) % 7 AS INT) AS end_line, turn, conv_id FROM conversations"""

#: Two snapshots of a folder: some files are in one only, and some have changed.
OLD = "SELECT concat('f', CAST(doc_id AS STRING)) AS path, CAST(n_chars AS DOUBLE) AS mtime FROM documents WHERE doc_id % 7 <> 0"
NEW = "SELECT concat('f', CAST(doc_id AS STRING)) AS path, CAST(n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS mtime FROM documents WHERE doc_id % 11 <> 0"

#: Texts with links.
NOTES = """SELECT CAST(doc_id AS STRING) AS path, concat('See [[a/', CAST(doc_id % 10 AS STRING), '.md#L', CAST(doc_id % 4 AS STRING), '|x]] and ![[ b.md ]] or [[a/', CAST(doc_id % 3 AS STRING), '.md]] [[]] ', text) AS text FROM documents"""

#: Two ranked lists of parts, of which the second has other ids at both ends.
MONTHLY = "SELECT CAST(p_partkey AS STRING) AS arxiv_id, p_name AS title, p_size AS upvotes, CAST(1 + (p_partkey * 7919) % 100003 AS INT) AS rank FROM part"
WEEKLY = "SELECT CAST(p_partkey + 70 AS STRING) AS arxiv_id, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS title, p_size + 1 AS upvotes, CAST(1 + (p_partkey * 104729) % 100003 AS INT) AS rank FROM part"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SQL text over the driver's tables."""
    used = {n: load(spark, sf_dir, n) for n in NAMES if f"FROM {n}" in sql or f"JOIN {n}" in sql}
    for n in used:
        sql = sql.replace(f"FROM {n}", "FROM {" + n + "}").replace(f"JOIN {n}", "JOIN {" + n + "}")
    return spark.sql(sql, **used)
