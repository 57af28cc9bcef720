"""The registered queries of the memory engine, each over whole tables, and their SQL in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.pages import plain_text
from ..operators import ann, bm25, changes, chunkers, evaluation, filters, fusion, graph, intervals, messages, notes, ranking, topics, vector
from ..sources import files
from ..streaming import change_feed
from ..streaming import seen as seen_state
from . import llm_columns, search, tables
from .tables import CHUNKS, LINKS, MONTHLY, NEW, NODES, NOTES, OLD, RANGES, WEEKLY, derive, load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


def big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# -- tokens and BM25 -----------------------------------------------------------

TOKENS = r"""SELECT *, list_transform(list_concat(regexp_extract_all(text, '[一-鿿]'), regexp_extract_all(regexp_replace(text, '[一-鿿]', ' ', 'g'), '[\p{L}\p{N}_]{2,}')), lambda x: lower(x)) AS tokens FROM documents"""
TERMS = "the that tion"


def bm25_sql(terms: str, where: str = "", limit: str = "") -> str:
    listed = ", ".join(f"'{t}'" for t in bm25.query_terms(terms))
    return f"""WITH t AS ({TOKENS}), p AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS token FROM t),
  n AS (SELECT count(*) AS n, avg(len(tokens)) AS a FROM t WHERE len(tokens) > 0),
  q AS (SELECT doc_id, token, dl, count(*) AS tf FROM p WHERE token IN ({listed}) GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM q GROUP BY token),
  s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * 0.25 + 1.5 * 0.75 / a * dl)) AS score FROM q JOIN d USING (token), n GROUP BY doc_id)
  SELECT doc_id, round(score, 6) AS score FROM s {where} {limit}"""


@query(f"SELECT doc_id, len(tokens)::BIGINT AS n_tokens, array_to_string(tokens, ' ') AS terms FROM ({TOKENS})")
def tokenize_terms(spark, d):
    return load(spark, d, "documents").select("doc_id", X.tokens("text").alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("terms"))


@query(f"WITH p AS (SELECT doc_id, unnest(tokens) AS token FROM ({TOKENS})), c AS (SELECT doc_id, token, count(*) AS tf FROM p GROUP BY ALL) SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf FROM c GROUP BY token")
def term_stats(spark, d):
    return bm25.postings(load(spark, d, "documents")).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"SELECT count(*) AS n_docs, sum(len(tokens))::BIGINT AS total_len, round(avg(len(tokens)), 6) AS avg_len FROM ({TOKENS}) WHERE len(tokens) > 0")
def corpus_stats(spark, d):
    return bm25.corpus_stats(bm25.postings(load(spark, d, "documents"))).select("n_docs", F.col("total_len").cast("bigint").alias("total_len"), F.round("avg_len", 6).alias("avg_len"))


@query(bm25_sql(TERMS, "", "ORDER BY s.score DESC, doc_id LIMIT 10"))
def bm25_topk(spark, d):
    return bm25.top_k(bm25.score_texts(load(spark, d, "documents"), TERMS), 10).select("doc_id", F.round("score", 6).alias("score"))


@query(bm25_sql(TERMS))
def bm25_index_scores(spark, d):
    index = bm25.postings(load(spark, d, "documents"))
    return bm25.score_index(index, bm25.corpus_stats(index), bm25.query_terms(TERMS)).select("doc_id", F.round("score", 6).alias("score"))


@query(bm25_sql(TERMS, "WHERE s.score >= 0.5"))
def bm25_min_score(spark, d):
    return bm25.score_texts(load(spark, d, "documents"), TERMS).where("score > 0 AND score >= 0.5").select("doc_id", F.round("score", 6).alias("score"))


@query(bm25_sql(TERMS, "WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')", "ORDER BY s.score DESC, doc_id LIMIT 10"))
def bm25_filtered(spark, d):
    scored = bm25.score_texts(load(spark, d, "documents"), TERMS, keep=["lang"])
    return bm25.top_k(scored.where("lang = 'en'"), 10).select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, CAST(floor(octet_length(encode(text)) / 4.0 + 0.5) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return load(spark, d, "documents").select("doc_id", X.token_estimate("text").cast("bigint").alias("tokens"))


# -- vectors -------------------------------------------------------------------

COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def first_vector(spark, d) -> list[float]:
    """The search's query vector, that of vec_id 0."""
    row = load(spark, d, "embeddings").where("vec_id = 0").first()
    return list(row["embedding"]) if row else [0.0]


@query(f"SELECT e.vec_id, round({COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {COS} DESC, e.vec_id LIMIT 10")
def vector_topk(spark, d):
    return vector.top_k(load(spark, d, "embeddings"), first_vector(spark, d), 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, round({COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY {COS} DESC, e.vec_id LIMIT 10")
def vector_filtered(spark, d):
    return vector.top_k(load(spark, d, "embeddings").where("label = 3"), first_vector(spark, d), 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT q.vec_id AS query_id, e.vec_id, round({COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0")
def cosine_pairs(spark, d):
    rows = load(spark, d, "embeddings")
    return vector.cosine_pairs(rows, rows.where("vec_id % 50 = 0"), "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS size, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def unit_vectors(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.round(V.norm("embedding"), 6).alias("size"), F.round(F.get(V.unit("embedding"), F.lit(0)), 6).alias("first"))


@query()
def vector_approximate(spark, d):
    """The ten nearest rows, found over cells, of every row whose id is divisible by 50."""
    rows = load(spark, d, "embeddings").select("vec_id", "embedding")
    first = rows.where("embedding IS NOT NULL").select(F.size("embedding")).first()
    cells = ann.fit(rows, first[0] if first else 1, 10, "vec_id")
    return ann.search(ann.index(rows, cells, "vec_id"), rows.where("vec_id % 50 = 0"), cells, 10, "vec_id").select("query_id", F.col("id").alias("vec_id"), *big("rank"), F.round("score", 6).alias("score"))


ALL_PAIRS = f"SELECT q.vec_id AS query_id, e.vec_id, {COS} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0"


@query(f"SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank, round(s, 6) AS score FROM ({ALL_PAIRS}) QUALIFY rank <= 10")
def vector_cells_exact(spark, d):
    """The same with all cells: the exact way."""
    rows = load(spark, d, "embeddings").select("vec_id", "embedding")
    first = rows.where("embedding IS NOT NULL").select(F.size("embedding")).first()
    cells = ann.fit(rows, first[0] if first else 1, 10, "vec_id")
    found = ann.search(ann.index(rows, cells, "vec_id"), rows.where("vec_id % 50 = 0"), cells, 10, "vec_id", probes=len(cells.centres))
    return found.select("query_id", F.col("id").alias("vec_id"), *big("rank"), F.round("score", 6).alias("score"))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 10 = 0 OR vec_id % 7 = 0")
def vectors_missing(spark, d):
    rows = load(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 3)).when(F.col("vec_id") % 10 != 0, F.col("embedding")))
    return vector.missing_vectors(rows, 64).select("vec_id")


@query("SELECT count(*) AS n, CAST(sum(('0x' || left(md5(concat(vec_id, ':', array_to_string(list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1099511627776) AS BIGINT)), ','))), 15))::BIGINT::HUGEINT) AS VARCHAR) AS digest FROM embeddings")
def vector_digest(spark, d):
    return vector.content_digest(load(spark, d, "embeddings"), "vec_id")


# -- fusion ----------------------------------------------------------------------

V_SQL = f"v AS (SELECT c.doc_id, c.path, row_number() OVER (ORDER BY {COS} DESC, c.id) AS r, {COS} AS s FROM ({CHUNKS}) c JOIN embeddings e ON c.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q {{where}} QUALIFY r <= {{k}})"
K_SQL = "k AS (SELECT b.doc_id, b.path, row_number() OVER (ORDER BY x.score DESC, b.id) AS r, x.score AS s FROM (" + bm25_sql(TERMS).replace("round(score, 6) AS score", "score") + f") x JOIN ({CHUNKS}) b ON b.doc_id = x.doc_id {{where}} QUALIFY r <= {{k}})"


def lists(k: int, where: str = "") -> str:
    return ("WITH " + V_SQL + ", " + K_SQL).replace("{k}", str(k)).replace("{where}", where)


def embedded_chunks(spark, d) -> DataFrame:
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    meta = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata")
    return derive(spark, d, CHUNKS).join(vectors, "doc_id", "left").select("id", "path", "start_line", "end_line", "text", "embedding", meta)


def shown(found: DataFrame) -> DataFrame:
    return found.select(*big("rank"), F.col("id").cast("bigint").alias("doc_id"), F.round("score", 6).alias("score"))


FUSED = "SELECT coalesce(v.doc_id, k.doc_id) AS doc_id, coalesce({w} / (60 + v.r), 0) + coalesce({u} / (60 + k.r), 0) AS score, v.r AS vr, k.r AS kr FROM v FULL JOIN k ON v.doc_id = k.doc_id"
RANKED = "SELECT row_number() OVER (ORDER BY score DESC, vr NULLS LAST, kr NULLS LAST) AS rank, doc_id, round(score, 6) AS score FROM f QUALIFY rank <= {n}"


@query(f"{lists(25)}, f AS ({FUSED.format(w=0.7, u='(1.0 - 0.7::DOUBLE)')}) {RANKED.format(n=5)}")
def rrf_hybrid(spark, d):
    return shown(search.hybrid(embedded_chunks(spark, d), TERMS, first_vector(spark, d), 5))


@query(f"{lists(50, 'WHERE path LIKE ' + chr(39) + 'digest/%' + chr(39))}, f AS ({FUSED.format(w=0.5, u=0.5)}) {RANKED.format(n=10)}")
def hybrid_prefix(spark, d):
    return shown(search.hybrid(embedded_chunks(spark, d), TERMS, first_vector(spark, d), 10, vector_weight=0.5, search_filter={"path_prefix": "digest/"}))


@query(f"{lists(25)} SELECT r AS rank, doc_id, round(s, 6) AS score FROM k WHERE r <= 5 AND s >= 0.1")
def single_branch(spark, d):
    return shown(search.hybrid(embedded_chunks(spark, d), TERMS, first_vector(spark, d), 5, min_score=0.1, vector_weight=0))


@query(f"{lists(50)} SELECT r AS rank, doc_id, round(s, 6) AS score FROM k WHERE r <= 5")
def keyword_search(spark, d):
    return shown(search.keyword(embedded_chunks(spark, d), TERMS, 5))


@query(f"{lists(50)} SELECT r AS rank, doc_id, round(s, 6) AS score FROM v WHERE r <= 5")
def nearest_search(spark, d):
    return shown(search.nearest(embedded_chunks(spark, d), first_vector(spark, d), 5))


NODE_LISTS = lists(100) + "".join(f", {x}d AS (SELECT path, row_number() OVER (ORDER BY min(r)) AS r FROM {x} WHERE path LIKE 'digest/%' GROUP BY path)" for x in "vk")


@query(f"{NODE_LISTS}, s AS (SELECT path, sum(p) AS score FROM (SELECT path, 0.7 / (60 + r) AS p FROM vd UNION ALL SELECT path, (1.0 - 0.7::DOUBLE) / (60 + r) FROM kd) GROUP BY path) SELECT path, round(score, 4) AS score, path AS name FROM s ORDER BY s.score DESC, path LIMIT 20")
def rrf_node_level(spark, d):
    chunks = embedded_chunks(spark, d)
    table = chunks.select("path", F.col("path").alias("name"), F.lit("").alias("description"))
    return search.nodes(chunks, table, TERMS, first_vector(spark, d), 20).select("path", "score", "name")


# -- filters -----------------------------------------------------------------------

DAY = r"regexp_extract(path, '^[^/]+/(\d{4}-\d{2}-\d{2})(?:\.md$|/|$)', 1)"


def filtered(spark, d, search_filter) -> DataFrame:
    rows = derive(spark, d, CHUNKS).withColumn("metadata", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    return rows.where(filters.predicate(filters.normalized(search_filter))).select("doc_id", "path")


@query(f"SELECT doc_id, path FROM ({CHUNKS}) WHERE {DAY} = '' OR ({DAY} >= '2024-01-05' AND {DAY} <= '2024-01-20')")
def path_date_filter(spark, d):
    return filtered(spark, d, {"start_date": "2024-1-5", "end_date": "2024-01-20T08:00"})


@query(f"SELECT doc_id, path FROM ({CHUNKS}) WHERE {DAY} >= '2024-01-05'")
def strict_date_filter(spark, d):
    return filtered(spark, d, {"start_date": "2024-01-05", "strict_date_filter": True})


@query(f"SELECT doc_id, path FROM ({CHUNKS}) WHERE path LIKE 'daily/%' OR path LIKE 'digest/wiki/%'")
def prefix_filter(spark, d):
    return filtered(spark, d, {"path_prefixes": ["daily/", "digest/wiki/"]})


@query(f"SELECT doc_id, path FROM ({CHUNKS}) WHERE path IN ('digest/wiki/n0.md', 'resource/n3.md', 'x')")
def path_equality(spark, d):
    return filtered(spark, d, {"path": "resource/n3.md", "paths": ["digest/wiki/n0.md", "x"]})


@query(f"SELECT doc_id, path FROM ({CHUNKS}) WHERE lang IN ('en', 'de') AND source = 'src0'")
def metadata_filter(spark, d):
    return filtered(spark, d, {"lang": ["en", "de"], "source": "src0", "missing": None})


@query(f"SELECT doc_id, nullif({DAY}, '') AS day, split_part(path, '/', 1) AS layer FROM ({CHUNKS})")
def path_parts(spark, d):
    return derive(spark, d, CHUNKS).select("doc_id", X.date_in_path("path").alias("day"), X.layer_of_path("path").alias("layer"))


@query("SELECT doc_id, sha256(concat_ws(' ', path, start_line::VARCHAR, end_line::VARCHAR, text)) AS id, left(sha1(path), 8) AS short, md5(sha1(path)) AS signed FROM (" + CHUNKS + ")")
def chunk_hashes(spark, d):
    return derive(spark, d, CHUNKS).select("doc_id", X.chunk_id("path", "start_line", "end_line", "text").alias("id"), X.short_hash("path").alias("short"), F.md5(F.sha1("path")).alias("signed"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9一-鿿]+', ' ', 'g')) AS norm FROM documents")
def topic_keys(spark, d):
    return load(spark, d, "documents").select("doc_id", X.topic_key("text").alias("norm"))


# -- links and graph -----------------------------------------------------------------


@query(
    r"""WITH m AS (SELECT path, regexp_extract_all(text, '!?\[\[([^\[\]|#\n]+?)(#[^\[\]|\n]+)?(\|[^\[\]\n]+)?\]\]', 1) AS t, regexp_extract_all(text, '!?\[\[([^\[\]|#\n]+?)(#[^\[\]|\n]+)?(\|[^\[\]\n]+)?\]\]', 2) AS a FROM ("""
    + NOTES
    + """)), u AS (SELECT path, unnest(t) AS t, unnest(a) AS a FROM m) SELECT DISTINCT path AS source_path, trim(t) AS target_path, CASE WHEN a <> '' THEN trim(a[2:]) END AS target_anchor FROM u WHERE trim(t) <> ''"""
)
def wikilinks_extract(spark, d):
    return graph.extract_links(derive(spark, d, NOTES)).drop("idx")


@query(r"SELECT path, regexp_replace(text, '(!?)\[\[\s*b\.md\s*(#[^\[\]|\n]+)?(\|[^\[\]\n]+)?\]\]', '\1[[c/d.md\2\3]]', 'g') AS text FROM (" + NOTES + ")")
def link_rewrite(spark, d):
    return derive(spark, d, NOTES).select("path", X.retarget("text", "b.md", "c/d.md").alias("text"))


@query(r"SELECT path, len(regexp_extract_all(text, '\[\[\s*a/1\.md\s*(#[^\[\]|\n]+)?(\|[^\[\]\n]+)?\]\]'))::BIGINT AS links FROM (" + NOTES + r") WHERE regexp_matches(text, '\[\[\s*a/1\.md\s*(#[^\[\]|\n]+)?(\|[^\[\]\n]+)?\]\]')")
def inbound_counts(spark, d):
    return notes.inbound_counts(derive(spark, d, NOTES), "a/1.md").select("path", *big("links"))


@query(r"""SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages) GROUP BY page_id""")
def page_links(spark, d):
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"')))
    return load(spark, d, "pages").select("page_id", href.alias("href")).groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("href").alias("targets"))


def the_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    return derive(spark, d, LINKS), derive(spark, d, NODES)


def scope_query(scope: str, test: str) -> None:
    sql = f"SELECT source_path, target_path, target_anchor FROM ({LINKS}) l WHERE {test}"

    @query(sql, f"links_scope_{scope}")
    def run(spark, d):
        links, nodes = the_graph(spark, d)
        return graph.scoped(links, nodes, scope).drop("idx")


scope_query("all", "TRUE")
scope_query("real", f"target_path IN (SELECT path FROM ({NODES}))")
scope_query("virtual", f"target_path NOT IN (SELECT path FROM ({NODES}))")


@query(f"SELECT target_path, target_anchor FROM ({LINKS}) l WHERE source_path = 'n/6'")
def outlinks_of_one(spark, d):
    return graph.outlinks(*the_graph(spark, d), "n/6").select("target_path", "target_anchor")


@query(f"SELECT source_path FROM ({LINKS}) l WHERE target_path = 'n/10'")
def inlinks_of_one(spark, d):
    return graph.inlinks(*the_graph(spark, d), "n/10").select("source_path")


@query(f"SELECT (SELECT count(*) FROM ({NODES})) AS real, (SELECT count(DISTINCT target_path) FROM ({LINKS}) l WHERE target_path NOT IN (SELECT path FROM ({NODES}))) AS virtual, (SELECT count(*) FROM ({LINKS}) l) AS edges")
def graph_counts(spark, d):
    return graph.counts(*the_graph(spark, d))


@query(f"WITH g AS (SELECT target_path AS path, source_path AS neighbour, min(idx) AS i FROM ({LINKS}) l GROUP BY ALL) SELECT path, neighbour, row_number() OVER (PARTITION BY path ORDER BY neighbour, i) AS nth FROM g QUALIFY nth <= 3")
def neighbour_cap(spark, d):
    return graph.neighbours(the_graph(spark, d)[0], "target_path", "source_path", 3).select("path", "neighbour", *big("nth"))


@query(
    f"""WITH l AS ({LINKS}), a AS (SELECT 'outlinks' AS direction, source_path AS path, target_path AS neighbour, min(idx) AS i FROM l GROUP BY ALL UNION ALL SELECT 'inlinks', target_path, source_path, min(idx) FROM l GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY direction, path ORDER BY CASE WHEN direction = 'outlinks' THEN CAST(i AS VARCHAR) ELSE neighbour END, neighbour) AS nth FROM a)
  SELECT r.path, direction, nth, neighbour, n.name, n.description FROM r LEFT JOIN ({NODES}) n ON n.path = r.neighbour WHERE nth <= 10 AND r.path IN (SELECT path FROM ({NODES}))"""
)
def link_expansion(spark, d):
    links, nodes = the_graph(spark, d)
    return graph.expand(nodes.select("path"), links, nodes, 10).select("path", "direction", *big("nth"), "neighbour", "name", "description")


def expansion_sql(links: str, nodes: str) -> str:
    """path, lines: what render_expansion says of all nodes, ten neighbours a direction."""
    side = lambda way, path, other: f"SELECT '{way}' AS direction, {path} AS path, {other} AS neighbour, min(idx) AS i, list(target_anchor ORDER BY idx, target_anchor) FILTER (length(target_anchor) > 0) AS anchors FROM l GROUP BY {path}, {other}"
    return f"""WITH l AS ({links}), n AS ({nodes}), a AS ({side("outlinks", "source_path", "target_path")} UNION ALL {side("inlinks", "target_path", "source_path")}),
  r AS (SELECT *, row_number() OVER (PARTITION BY direction, path ORDER BY CASE WHEN direction = 'outlinks' THEN CAST(i AS VARCHAR) ELSE neighbour END, neighbour) AS nth FROM a QUALIFY nth <= 10),
  b AS (SELECT r.path, direction, nth, '    ' || CASE WHEN direction = 'outlinks' THEN '→' ELSE '←' END || ' ' || neighbour || '  ' || coalesce(nullif(concat_ws('  ', CASE WHEN length(n.name) > 0 THEN 'name="' || n.name || '"' END, CASE WHEN length(n.description) > 0 THEN 'description="' || n.description || '"' END), ''), '(no meta)')
    || coalesce(array_to_string(list_transform(anchors, lambda x: chr(10) || '          via anchor=#' || x), ''), '') AS block FROM r LEFT JOIN n ON n.path = r.neighbour WHERE r.path IN (SELECT path FROM n)),
  s AS (SELECT path, direction, '  ' || direction || ' (' || count(*) || '):' || chr(10) || string_agg(block, chr(10) ORDER BY nth) AS side FROM b GROUP BY path, direction)
  SELECT path, string_agg(side, chr(10) ORDER BY CASE direction WHEN 'outlinks' THEN 0 ELSE 1 END) AS lines FROM s GROUP BY path"""


@query(expansion_sql(LINKS, NODES))
def link_expansion_text(spark, d):
    links, nodes = the_graph(spark, d)
    return graph.render_expansion(graph.expand(nodes.select("path"), links, nodes, 10))


ANSWER_LINKS = f"SELECT c.path AS source_path, b.path AS target_path, CAST(NULL AS STRING) AS target_anchor, 0 AS idx FROM ({CHUNKS}) c JOIN ({CHUNKS}) b ON b.doc_id = (c.doc_id * 7 + 3) % 200"


@query(
    f"""WITH e AS ({expansion_sql(ANSWER_LINKS, f"SELECT path, 'a note' AS name, '' AS description FROM ({CHUNKS})")}), found AS ({lists(25)}, f AS ({FUSED.format(w=0.7, u='(1.0 - 0.7::DOUBLE)')}) {RANKED.format(n=5)})
  SELECT string_agg(concat_ws(chr(10), '========== ' || c.path || ':1-10 [score=' || printf('%.4f', score) || '] ==========' || chr(10) || text, lines), chr(10) ORDER BY rank) AS answer FROM found JOIN ({CHUNKS}) c ON c.doc_id = found.doc_id LEFT JOIN e ON e.path = c.path"""
)
def search_answer(spark, d):
    chunks = embedded_chunks(spark, d)
    found = search.hybrid(chunks, TERMS, first_vector(spark, d), 5)
    return search.answer(found, derive(spark, d, ANSWER_LINKS), chunks.select("path", F.lit("a note").alias("name"), F.lit("").alias("description")))


@query(
    f"""WITH found AS ({lists(40)}, f AS ({FUSED.format(w=0.7, u='(1.0 - 0.7::DOUBLE)')}) {RANKED.format(n=400)})
  SELECT row_number() OVER (ORDER BY rank) AS place, path, start_line, end_line, text, score FROM found JOIN ({CHUNKS}) c ON c.doc_id = found.doc_id WHERE c.doc_id >= 5 QUALIFY place <= 8"""
)
def search_passages(spark, d):
    """What the first five documents have was given before."""
    seen = derive(spark, d, f"SELECT path, start_line, end_line FROM ({CHUNKS}) WHERE doc_id < 5")
    found = search.passages(embedded_chunks(spark, d), TERMS, first_vector(spark, d), 8, seen_ranges=seen)
    return found.select(*big("place"), "path", "start_line", "end_line", "text", F.round("score", 6).alias("score"))


def walk_sql(direction: str, depth: int) -> tuple[str, str]:
    ways = {"forward": "SELECT source_path AS here, target_path AS there, * FROM l", "backward": "SELECT target_path AS here, source_path AS there, * FROM l"}
    both = ways["forward"] + " UNION ALL " + ways["backward"] if direction == "both" else ways[direction]
    head = f"WITH RECURSIVE l AS (SELECT DISTINCT source_path, target_path, target_anchor FROM ({LINKS}) l), w AS ({both}), b AS (SELECT 'n/1' AS path, 0 AS depth UNION SELECT w.there, b.depth + 1 FROM b JOIN w ON w.here = b.path WHERE b.depth < {depth}), m AS (SELECT path, min(depth) AS depth FROM b GROUP BY path) "
    return (
        head + f"SELECT m.path, CAST(m.depth AS BIGINT) AS depth, coalesce(n.name, '') AS name, n.path IS NOT NULL AS indexed FROM m LEFT JOIN ({NODES}) n ON n.path = m.path",
        head + f"SELECT source_path, target_path, target_anchor, CAST(min(m.depth) + 1 AS BIGINT) AS depth FROM m JOIN w ON w.here = m.path WHERE m.depth < {depth} GROUP BY source_path, target_path, target_anchor",
    )


def walk_queries(direction: str, depth: int) -> None:
    nodes_sql, links_sql = walk_sql(direction, depth)

    @query(nodes_sql, f"bfs_{direction}")
    def found(spark, d):
        return graph.traverse(*the_graph(spark, d), ["n/1"], depth, direction)[0].select("path", *big("depth"), "name", "indexed")

    @query(links_sql, f"bfs_{direction}_links")
    def walked(spark, d):
        return graph.traverse(*the_graph(spark, d), ["n/1"], depth, direction)[1].select("source_path", "target_path", "target_anchor", *big("depth"))


for _direction in ("forward", "backward", "both"):
    walk_queries(_direction, 3)

SNAP_NODES = f"SELECT path, id AS name, lang AS description FROM ({CHUNKS})"
SNAP_LINKS = f"SELECT c.path AS source_path, b.path AS target_path, CASE WHEN c.doc_id % 5 = 0 THEN 'L1' END AS target_anchor FROM ({CHUNKS}) c JOIN ({CHUNKS}) b ON b.doc_id = (c.doc_id * 7 + 3) % 200 UNION ALL SELECT c.path, b.path, CAST(NULL AS STRING) FROM ({CHUNKS}) c JOIN ({CHUNKS}) b ON b.doc_id = (c.doc_id + 2) % 190"
SNAP_EDGES = f"SELECT DISTINCT source_path AS source, target_path AS target, target_anchor FROM ({SNAP_LINKS}) WHERE source_path LIKE 'digest/%' AND (target_path LIKE 'digest/%' OR target_path LIKE 'daily/%')"
ROOTS = "SELECT concat('virtual:', b) AS id, concat('digest/', b) AS path, b AS name, '' AS description, FALSE AS indexed, TRUE AS virtual FROM (SELECT unnest(['wiki', 'personal', 'procedure']) AS b)"


@query(f"{ROOTS} UNION ALL SELECT path, path, name, description, TRUE, FALSE FROM ({SNAP_NODES}) WHERE path LIKE 'digest/%' OR path IN (SELECT target FROM ({SNAP_EDGES}) WHERE target LIKE 'daily/%')")
def graph_snapshot_nodes(spark, d):
    return graph.snapshot(derive(spark, d, SNAP_NODES), derive(spark, d, SNAP_LINKS))[0]


@query(f"{SNAP_EDGES} UNION ALL SELECT concat('virtual:', split_part(path, '/', 2)), path, NULL FROM ({SNAP_NODES}) WHERE path LIKE 'digest/%'")
def graph_snapshot_edges(spark, d):
    return graph.snapshot(derive(spark, d, SNAP_NODES), derive(spark, d, SNAP_LINKS))[1]


# -- ranges --------------------------------------------------------------------------

ISLANDS = "SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN start_line > max(end_line) OVER (PARTITION BY path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM ({rows}))"
MERGED = "SELECT path, min(start_line) AS start_line, max(end_line) AS end_line FROM (" + ISLANDS + ") GROUP BY path, island"


@query("SELECT path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line FROM (" + MERGED.format(rows=RANGES) + ")")
def interval_merge(spark, d):
    return intervals.merge(derive(spark, d, RANGES), "path").select("path", *big("start_line", "end_line"))


SEEN = f"SELECT * FROM ({RANGES}) WHERE turn < 2"


@query(f"SELECT path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line FROM ({RANGES}) r WHERE NOT EXISTS (SELECT 1 FROM ({MERGED.format(rows=SEEN)}) m WHERE m.path = r.path AND m.start_line <= r.start_line AND r.end_line <= m.end_line)")
def interval_cover_dedupe(spark, d):
    return intervals.uncovered(derive(spark, d, RANGES), derive(spark, d, SEEN), "path").select("path", *big("start_line", "end_line"))


@query(f"SELECT path, start_line::BIGINT AS start_line, turn, min(turn) OVER (PARTITION BY path) AS path_rank FROM ({RANGES})")
def path_reorder(spark, d):
    return intervals.by_path(derive(spark, d, RANGES), rank="turn").select("path", *big("start_line"), "turn", "path_rank")


PASSAGES = f"SELECT path, start_line, end_line, concat_ws(chr(10), 'a', 'b', CAST(turn AS STRING)) AS text, CAST(1.0 / (turn + 1) AS DOUBLE) AS score FROM (SELECT path, CAST(turn * 2 AS INT) AS start_line, CAST(turn * 2 + 2 AS INT) AS end_line, turn FROM ({RANGES}))"


@query(
    f"""WITH i AS ({ISLANDS.format(rows=PASSAGES)}), l AS (SELECT path, island, start_line, end_line, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM i),
  m AS (SELECT path, island, start_line + pos AS no, arg_max(line, start_line) AS line FROM l GROUP BY ALL), t AS (SELECT path, island, string_agg(line || chr(10), '' ORDER BY no) AS text FROM m GROUP BY ALL), h AS (SELECT path, island, min(start_line)::BIGINT AS start_line, max(end_line)::BIGINT AS end_line, round(max(score), 6) AS score, count(*) AS n, any_value(text) AS own FROM i GROUP BY ALL)
  SELECT path, start_line, end_line, CASE WHEN n = 1 THEN own ELSE text END AS text, score FROM h JOIN t USING (path, island)"""
)
def session_union(spark, d):
    return intervals.union_passages(derive(spark, d, PASSAGES), "path").select("path", *big("start_line", "end_line"), "text", F.round("score", 6).alias("score"))


@query("SELECT conv_id, 'L' || min(turn + 1) || CASE WHEN max(turn) > min(turn) THEN '-L' || max(turn + 1) ELSE '' END AS anchor FROM conversations GROUP BY conv_id")
def line_anchors(spark, d):
    rows = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.concat(F.lit("L"), (t + 1).cast("string"))), ",").alias("a"))
    return rows.select("conv_id", X.line_anchor(X.line_ranges("a")).alias("anchor"))


# -- changes ---------------------------------------------------------------------------

DIFF = f"SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' WHEN a.mtime <> b.mtime THEN 'modified' END AS change FROM ({NEW}) a FULL JOIN ({OLD}) b ON a.path = b.path"
EVENTS = "SELECT concat('f', CAST(user_id % 500 AS STRING)) AS path, CASE event_id % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'deleted' END AS change FROM events"


@query(f"SELECT * FROM ({DIFF}) WHERE change IS NOT NULL")
def diff_changes(spark, d):
    return changes.diff(derive(spark, d, NEW), derive(spark, d, OLD))


@query(f"SELECT change, count(*) AS n FROM ({DIFF}) WHERE change IS NOT NULL GROUP BY change")
def change_buckets(spark, d):
    return changes.buckets(changes.diff(derive(spark, d, NEW), derive(spark, d, OLD)))


@query(f"SELECT e.path, CASE WHEN any_value(x.path) IS NULL THEN 'deleted' WHEN list_distinct(list(change)) = ['added'] THEN 'added' ELSE 'modified' END AS change FROM ({EVENTS}) e LEFT JOIN ({NEW}) x ON x.path = e.path GROUP BY e.path")
def coalesce_changes(spark, d):
    return changes.coalesce(derive(spark, d, EVENTS), derive(spark, d, NEW))


@query(f"SELECT (SELECT count(*) FROM ({NEW}) WHERE path NOT IN (SELECT path FROM ({OLD}))) AS missing, (SELECT count(*) FROM ({OLD}) WHERE path NOT IN (SELECT path FROM ({NEW}))) AS orphaned")
def consistency_check(spark, d):
    return changes.consistency(derive(spark, d, NEW), derive(spark, d, OLD), "path")


@query(f"SELECT path, 'missing' AS state FROM ({NEW}) WHERE path NOT IN (SELECT path FROM ({OLD})) UNION ALL SELECT path, 'stale' FROM ({OLD}) WHERE path NOT IN (SELECT path FROM ({NEW}))")
def index_sync(spark, d):
    return changes.out_of_sync(derive(spark, d, NEW), derive(spark, d, OLD), "path")


DAY_FILES = "SELECT concat('daily/2024-01-0', CAST(1 + doc_id % 4 AS STRING), '/', CAST(doc_id AS STRING), '.md') AS path, CAST(n_chars AS DOUBLE) AS mtime FROM documents WHERE doc_id % {skip} <> 0"


@query(
    f"SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'deleted' WHEN a.mtime IS NOT DISTINCT FROM b.mtime THEN 'unchanged' ELSE 'changed' END AS state FROM (SELECT * FROM ({DAY_FILES.format(skip=5)}) WHERE path < 'daily/2024-01-03') a FULL JOIN (SELECT * FROM ({DAY_FILES.format(skip=3)}) WHERE path < 'daily/2024-01-03') b ON a.path = b.path"
)
def dream_diff(spark, d):
    return changes.window_diff(derive(spark, d, DAY_FILES.format(skip=5)), derive(spark, d, DAY_FILES.format(skip=3)), ["2024-01-01", "2024-01-02"])


@query("SELECT CAST(1 + doc_id % 2 AS BIGINT) AS version, count(*) AS n FROM documents WHERE n_chars <= 2000 GROUP BY ALL")
def size_gate(spark, d):
    small, _ = changes.by_size(load(spark, d, "documents"), 2000, "n_chars")
    return small.groupBy((1 + F.col("doc_id") % 2).alias("version")).agg(F.count("*").alias("n"))


# -- chunkers ----------------------------------------------------------------------------


@query("SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, CAST(i * 9900 AS BIGINT) AS start_byte, CAST(least(10000, n - i * 9900) AS BIGINT) AS n_bytes FROM (SELECT doc_id, n, unnest(generate_series(0, CAST(greatest(ceil((n - 10000) / 9900.0), 0) AS BIGINT))) AS i FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) WHERE n > 0)")
def chunk_bytes(spark, d):
    return chunkers.byte_windows(load(spark, d, "documents"), "doc_id").select(F.col("path").alias("doc_id"), *big("chunk_index", "start_byte", "n_bytes"))


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS chunks FROM (SELECT doc_id, unnest(generate_series(0, CAST(greatest(ceil((n - 10000) / 9900.0), 0) AS BIGINT))) AS i FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) WHERE n > 0) GROUP BY doc_id")
def chunk_default(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return chunkers.chunk(docs, "default").groupBy(F.col("path").cast("bigint").alias("doc_id")).agg(F.count("*").alias("chunks"))


SAID = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n, to_json({'turn': turn, 'role': role, 'text': text})::VARCHAR AS line FROM conversations"


@query(
    f"""WITH RECURSIVE l AS (SELECT conv_id, i, CASE WHEN i < n THEN line || chr(10) ELSE line END AS line FROM ({SAID})), r AS (SELECT conv_id, i, line, length(line) AS used, 0 AS chunk_index FROM l WHERE i = 1
  UNION ALL SELECT l.conv_id, l.i, l.line, CASE WHEN r.used + length(l.line) <= 2000 THEN r.used + length(l.line) ELSE length(l.line) END, CASE WHEN r.used + length(l.line) <= 2000 THEN r.chunk_index ELSE r.chunk_index + 1 END FROM r JOIN l ON l.conv_id = r.conv_id AND l.i = r.i + 1),
  c AS (SELECT conv_id || '.jsonl' AS path, chunk_index, CAST(min(i) AS INTEGER) AS start_line, CAST(max(i) AS INTEGER) AS end_line, string_agg(line, '' ORDER BY i) AS text FROM r GROUP BY ALL)
  SELECT *, sha256(concat_ws(' ', path, start_line::VARCHAR, end_line::VARCHAR, text)) AS id FROM c"""
)
def chunk_jsonl(spark, d):
    lines = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.to_json(m)), "\n").alias("text"))
    return chunkers.chunk(lines.withColumn("path", F.concat("conv_id", F.lit(".jsonl"))))


@query("SELECT path, 0 AS chunk_index, 1 AS start_line, 1 AS end_line, text, sha256(concat_ws(' ', path, '1', '1', text)) AS id FROM (SELECT event_id || '.json' AS path, props AS text FROM events)")
def chunk_json(spark, d):
    return chunkers.chunk(load(spark, d, "events").select(F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.col("props").alias("text")))


@query()
def chunk_markdown(spark, d):
    body = F.concat(F.lit("---\nname: x\n---\n# "), F.left("text", F.lit(20)), F.lit("\n\n"), "text", F.lit("\n\n## More\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"))
    return chunkers.chunk(load(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), body.alias("text")))


# -- conversations -------------------------------------------------------------------------


@query("SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN concat('new ', text) ELSE text END AS text FROM conversations)")
def message_merge(spark, d):
    rows = load(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.col("turn").alias("id"), F.col("turn").alias("created_at"), F.col("turn").alias("line_no"))
    new = rows.where("turn % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    return messages.merge(rows, new, "conv_id").select("conv_id", "turn", "role", "text", *big("place"))


@query("SELECT conv_id, turn, CAST(CASE WHEN first(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' THEN 0 ELSE 1 END + sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_no FROM conversations")
def turns(spark, d):
    return messages.turns(load(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", *big("turn_no"))


WORDED = "SELECT conv_id, turn, CASE WHEN first(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' THEN 0 ELSE 1 END + sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no, len(list_filter(string_split_regex(trim(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS words FROM conversations"


@query(
    f"""WITH RECURSIVE p AS (SELECT conv_id, turn_no, sum(words) AS w, count(*) AS n FROM ({WORDED}) GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_no) AS i, sum(n) OVER (PARTITION BY conv_id ORDER BY turn_no) - n AS at FROM p),
  r AS (SELECT conv_id, turn_no, i, w AS used, CAST(0 AS HUGEINT) AS segment FROM q WHERE i = 1 UNION ALL SELECT q.conv_id, q.turn_no, q.i, CASE WHEN q.at > r.segment AND r.used + q.w > 120 THEN q.w ELSE r.used + q.w END, CASE WHEN q.at > r.segment AND r.used + q.w > 120 THEN q.at ELSE r.segment END FROM r JOIN q ON q.conv_id = r.conv_id AND q.i = r.i + 1)
  SELECT t.conv_id, t.turn, CAST(r.segment AS INTEGER) AS segment FROM ({WORDED}) t JOIN r ON r.conv_id = t.conv_id AND r.turn_no = t.turn_no"""
)
def segments(spark, d):
    return messages.segments(load(spark, d, "conversations"), "conv_id", "turn", 120).select("conv_id", "turn", "segment")


@query("SELECT conv_id, turn, last(a IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS anchor FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN concat('t', CAST(turn AS STRING)) END AS a FROM conversations)")
def locf(spark, d):
    rows = load(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("a"))
    return messages.carried_anchor(rows, "conv_id", "turn", "a").select("conv_id", "turn", F.col("anchor_at").alias("anchor"))


TIMED = "SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN ts END AS stamp FROM events"


@query(
    f"""WITH p AS (SELECT event_id, user_id, stamp, row_number() OVER w AS i FROM ({TIMED}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), q AS (SELECT *, epoch_us(stamp) AS t,
  last(CASE WHEN stamp IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i0, last(epoch_us(stamp) IGNORE NULLS) OVER a AS t0, first(CASE WHEN stamp IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i1, first(epoch_us(stamp) IGNORE NULLS) OVER b AS t1 FROM p
  WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT event_id, CAST(round(CASE WHEN t IS NOT NULL THEN t::DOUBLE WHEN t0 IS NULL THEN t1::DOUBLE WHEN t1 IS NULL THEN t0::DOUBLE ELSE t0 + (t1 - t0) * ((i - i0) / nullif(i1 - i0, 0)) END) AS BIGINT) AS filled FROM q"""
)
def interpolate(spark, d):
    return messages.interpolated(derive(spark, d, TIMED), "user_id", "event_id", "stamp").select("event_id", F.unix_micros(F.col("filled_at").cast("timestamp")).alias("filled"))


@query("SELECT user_id, CAST(max(CAST(ts + INTERVAL 8 HOUR AS DATE)) AS VARCHAR) AS day FROM events GROUP BY user_id")
def conversation_day(spark, d):
    return messages.day_of(load(spark, d, "events"), "user_id", at="ts", zone="Asia/Shanghai").select("user_id", F.col("day").cast("string").alias("day"))


@query("SELECT event_id, coalesce(CAST(ts AS DATE) <> CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DATE), TRUE) AS is_new_day FROM events")
def session_new_day(spark, d):
    rows = load(spark, d, "events")
    return messages.new_day(rows, "user_id", "ts", "event_id").select("event_id", "is_new_day")


@query("WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, text AS \"user\", CASE WHEN nr = 'assistant' THEN nt END AS assistant FROM t WHERE role = 'user'")
def turn_pairs(spark, d):
    return messages.pairs(load(spark, d, "conversations"), "conv_id", "turn").select("conv_id", *big("nth"), "user", "assistant")


@query("SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND length(trim(text)) > 0")
def spoken_messages(spark, d):
    return messages.spoken(load(spark, d, "conversations")).select("conv_id", "turn")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def history(spark, d):
    return messages.history(load(spark, d, "conversations"), "conv_id", order="turn")


@query("SELECT conv_id, turn, rtrim('[' || role || ' @ t' || turn || '] ' || trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS line FROM conversations".replace("\\\\", "\\"))
def session_lines(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", X.flat_line("role", F.concat(F.lit("t"), F.col("turn").cast("string")), "text").alias("line"))


@query("SELECT conv_id, turn, role FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.turn = c.turn AND s.turn < 3)")
def transcript_increment(spark, d):
    rows = load(spark, d, "conversations")
    return messages.new_rows(rows, rows.where("turn < 3"), "conv_id", "turn").select("conv_id", "turn", "role")


@query("SELECT conv_id, conv_id % 2 <> 0 AS append FROM conversations GROUP BY conv_id")
def can_append(spark, d):
    """Half of the conversations get a message after all others, half one before them."""
    rows = load(spark, d, "conversations").select("conv_id", F.col("turn").alias("id"), F.col("turn").alias("created_at"), F.col("turn").alias("line_no"), F.col("turn").alias("place"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("created_at")) - 1)
    new = rows.groupBy("conv_id").agg(F.max("id").alias("last")).select("conv_id", (F.col("last") + 1).alias("id"), F.when(F.col("conv_id") % 2 == 0, F.lit(-1)).otherwise(F.col("last") + 1).cast("bigint").alias("created_at"), (F.col("last") + 1).alias("line_no"))
    return messages.can_append(rows, messages.merge(rows.drop("place"), new, "conv_id"), "conv_id")


# -- topics, papers, news ------------------------------------------------------------------

TITLES = "SELECT doc_id, CAST(doc_id % 20 AS STRING) AS day, text AS title FROM documents"


@query(
    f"""WITH t AS (SELECT doc_id, day, title, trim(regexp_replace(lower(title), '[^a-z0-9一-鿿]+', ' ', 'g')) AS norm FROM ({TITLES})), s AS (SELECT * FROM t WHERE doc_id < 40), n AS (SELECT * FROM t WHERE doc_id >= 40 AND norm <> ''),
  f AS (SELECT *, row_number() OVER (PARTITION BY day, norm ORDER BY doc_id) AS nth FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.day = n.day AND s.norm = n.norm)), b AS (SELECT doc_id, day, title, 0 AS old FROM s UNION ALL SELECT doc_id, day, title, 1 FROM f WHERE nth = 1)
  SELECT doc_id, day, title, row_number() OVER (PARTITION BY day ORDER BY old, doc_id) AS place FROM b QUALIFY place <= 8"""
)
def topic_dedupe(spark, d):
    rows = derive(spark, d, TITLES)
    same = rows.where("doc_id < 40")
    return topics.dedupe_topics(rows.where("doc_id >= 40"), same, same.limit(0), 8, "day", order="doc_id").select("doc_id", "day", "title", *big("place"))


MERGED_LISTS = f"SELECT coalesce(m.arxiv_id, w.arxiv_id) AS arxiv_id, coalesce(nullif(m.title, ''), w.title, m.title) AS title, CAST(greatest(coalesce(m.upvotes, 0), coalesce(w.upvotes, 0)) AS BIGINT) AS upvotes, CAST(m.rank AS BIGINT) AS monthly_rank, CAST(w.rank AS BIGINT) AS weekly_rank FROM ({MONTHLY}) m FULL JOIN ({WEEKLY}) w ON m.arxiv_id = w.arxiv_id"


def merged_lists(spark, d) -> DataFrame:
    return ranking.merge_lists(derive(spark, d, MONTHLY), derive(spark, d, WEEKLY)).select("arxiv_id", "title", *big("upvotes", "monthly_rank", "weekly_rank"))


@query(MERGED_LISTS)
def paper_merge(spark, d):
    return merged_lists(spark, d)


@query(f"WITH p AS (SELECT *, coalesce(1.0::DOUBLE / (60 + monthly_rank), 0) + coalesce(0.7::DOUBLE / (60 + weekly_rank), 0) AS s FROM ({MERGED_LISTS}) WHERE arxiv_id NOT IN (SELECT CAST(p_partkey AS STRING) FROM part WHERE p_size = 25)) SELECT arxiv_id, upvotes, round(s, 6) AS fused_score FROM p ORDER BY s DESC, upvotes DESC, arxiv_id LIMIT 20")
def paper_rank(spark, d):
    gone = load(spark, d, "part").where("p_size = 25").select(F.col("p_partkey").cast("string").alias("arxiv_id"))
    return ranking.candidates(merged_lists(spark, d), gone).select("arxiv_id", "upvotes", F.round("fused_score", 6).alias("fused_score"))


NEWS = "SELECT CAST(event_id % 4000 AS STRING) AS news_id, ts AS event_time, event_type AS title, props AS content, event_id AS page_order FROM events"


@query(f"WITH e AS (SELECT * FROM ({NEWS}) n, (SELECT max(ts) AS b FROM events) WHERE event_time BETWEEN b - INTERVAL 240 HOUR AND b) SELECT news_id, page_order FROM e QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY page_order) = 1")
def news_window(spark, d):
    last = load(spark, d, "events").agg(F.max("ts").alias("b"))
    rows = derive(spark, d, NEWS).join(F.broadcast(last))
    return ranking.news_window(rows, F.col("b") - F.expr("INTERVAL 240 HOUR"), F.col("b")).select("news_id", "page_order")


HTML = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?(?:</script\s*>|\z)', chr(1), 'g'), '(?is)<style\b.*?(?:</style\s*>|\z)', chr(1), 'g'), '(?s)<!--.*?(?:-->|\z)', chr(1), 'g'), '(?i)</?(?:div|li|p)\b[^>]*>|<br\b[^>]*>', ' ', 'g'), '<[/!?]?[A-Za-z][^>]*(?:>|\z)', chr(1), 'g')"""
NAMED = ("quot", "&quot;", '"'), ("copy", "&copy;", "©"), ("middot", "&middot;", "·"), ("lt", "&lt;", "<"), ("gt", "&gt;", ">"), ("amp", "&amp;", "&")
for _name, _, _sign in NAMED:
    HTML = f"regexp_replace({HTML}, '&{_name};?', '{_sign}', 'g')"


@query(rf"SELECT page_id, trim(regexp_replace(replace({HTML}, chr(1), ''), '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) AS text FROM pages")
def html_plain_text(spark, d):
    return load(spark, d, "pages").select("page_id", plain_text("html").alias("text"))


@query("SELECT CAST(s.day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(o_orderdate)::DATE FROM orders), (SELECT max(o_orderdate)::DATE FROM orders), INTERVAL 1 DAY))::DATE AS day) s LEFT JOIN (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY ALL) c ON c.day = s.day")
def date_spine(spark, d):
    return ranking.date_spine(load(spark, d, "orders"), "o_orderdate").select(F.col("day").cast("string").alias("day"), "n")


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_count(spark, d):
    return load(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def week_labels(spark, d):
    return load(spark, d, "orders").select("o_orderkey", X.iso_week("o_orderdate").alias("week"), X.month_label("o_orderdate").alias("month"))


@query("SELECT CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 50) AS BIGINT) AS batch, event_id, left(props, 1000) AS props FROM events")
def news_batches(spark, d):
    return ranking.numbered_batches(load(spark, d, "events"), 50, "ts", "event_id", text="props", part=F.to_date("ts")).select(*big("batch"), "event_id", "props")


# -- evaluation -----------------------------------------------------------------------------


@query("SELECT lang, sum(quality)::BIGINT AS correct, count(*) AS total, round(avg(quality) * 100, 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def eval_accuracy(spark, d):
    rows = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return evaluation.accuracy(rows, "lang", F.col("quality") == 1).select("lang", "correct", "total", F.round("accuracy", 6).alias("accuracy"))


@query("WITH q AS (SELECT l_orderkey, avg(1 - l_discount * 10) AS score, avg(CASE WHEN 1 - l_discount * 10 >= 1 THEN 1.0 ELSE 0.0 END) AS b, any_value(o_orderpriority) AS kind FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey) SELECT kind, round(avg(score), 6) AS score, round(avg(b), 6) AS binary_score, count(*) AS n FROM q GROUP BY kind")
def eval_rubric(spark, d):
    items = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(1 - F.col("l_discount") * 10).alias("scores"), F.avg(1 - F.col("l_discount") * 10).alias("score"))
    rows = items.join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("kind")), "l_orderkey")
    return evaluation.rubric(rows, "kind").select("kind", F.round("score", 6).alias("score"), F.round("binary_score", 6).alias("binary_score"), "n")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def mean_std(spark, d):
    return evaluation.mean_std(load(spark, d, "events"), "event_type", value="value").select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_status(spark, d):
    return evaluation.latest_status(load(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


PAIRED = "SELECT o_custkey % 40 AS k, CAST(o_orderkey % 17 AS BIGINT) AS x, CAST(floor(o_totalprice / 40000) AS BIGINT) AS y, o_orderkey FROM orders"


@query(
    f"""WITH r AS ({PAIRED}), p AS (SELECT a.k, sign(b.x - a.x) AS dx, sign(b.y - a.y) AS dy FROM r a JOIN r b ON a.k = b.k AND a.o_orderkey < b.o_orderkey), s AS (SELECT k, sum(CASE WHEN dx * dy > 0 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN dx * dy < 0 THEN 1 ELSE 0 END) AS d, sum(CASE WHEN dx = 0 THEN 1 ELSE 0 END) AS xt, sum(CASE WHEN dy = 0 THEN 1 ELSE 0 END) AS yt FROM p GROUP BY k), n AS (SELECT k, count(*) AS n FROM r GROUP BY k)
  SELECT n.k, round(CASE WHEN n < 2 OR (n * (n - 1) / 2 - xt) * (n * (n - 1) / 2 - yt) <= 0 THEN 0 ELSE (c - d) / sqrt((n * (n - 1) / 2 - xt) * (n * (n - 1) / 2 - yt)) END, 6)::DOUBLE AS tau FROM n LEFT JOIN s ON s.k = n.k"""
)
def kendall(spark, d):
    return evaluation.kendall(derive(spark, d, PAIRED), "k").select("k", F.round("tau", 6).alias("tau"))


@query("SELECT user_id, sum(coalesce(CASE WHEN event_id % 2 = 0 THEN event_id END, CASE WHEN event_id % 3 = 0 THEN 7 END))::BIGINT AS input_tokens, sum(CASE WHEN event_id % 5 = 0 THEN 2 END)::BIGINT AS output_tokens, CASE WHEN input_tokens IS NOT NULL OR output_tokens IS NOT NULL THEN coalesce(input_tokens, 0) + coalesce(output_tokens, 0) END AS total_tokens FROM events GROUP BY user_id")
def token_usage(spark, d):
    e = F.col("event_id")
    rows = load(spark, d, "events").select("user_id", F.when(e % 2 == 0, e).alias("input_tokens"), F.when(e % 3 == 0, F.lit(7).cast("bigint")).alias("prompt_tokens"), F.when(e % 5 == 0, F.lit(2).cast("bigint")).alias("output_tokens"))
    return evaluation.token_usage(rows, "user_id")


COUNTED = "SELECT event_id AS seq, event_type AS name, CAST(user_id % 5 AS BIGINT) AS delta FROM events"


@query(f"SELECT seq, name, delta, coalesce(sum(delta) OVER (PARTITION BY name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS previous FROM ({COUNTED})")
def counter_previous(spark, d):
    return evaluation.previous_values(derive(spark, d, COUNTED), "name")


@query(f"SELECT name, sum(delta)::BIGINT AS value FROM ({COUNTED}) GROUP BY name")
def counter_totals(spark, d):
    return evaluation.counters(derive(spark, d, COUNTED).withColumn("path", F.array(F.lit("all"), "name"))).select(F.get("path", F.lit(1)).alias("name"), "value")


@query(f"WITH a AS (SELECT name, sum(delta)::BIGINT AS v FROM ({COUNTED}) WHERE seq < 500 GROUP BY name), b AS (SELECT name, sum(delta)::BIGINT AS v FROM ({COUNTED}) GROUP BY name) SELECT b.name, b.v - a.v AS delta FROM a FULL JOIN b ON a.name = b.name")
def counter_delta(spark, d):
    rows = derive(spark, d, COUNTED)
    return evaluation.counter_delta(evaluation.counters(rows.where("seq < 500"), "name"), evaluation.counters(rows, "name"), "name")


@query("SELECT doc_id, CASE WHEN q = 1 THEN 'yes' ELSE 'no' END AS verdict FROM (SELECT doc_id, quality AS q FROM labels)")
def verdicts(spark, d):
    return load(spark, d, "labels").select("doc_id", X.verdict(F.when(F.col("quality") == 1, " Yes, it is").otherwise("NO.")).alias("verdict"))


@query("SELECT p_partkey, CAST(greatest(1.0, m * CASE WHEN r / m <= 1 THEN 1 WHEN r / m <= 2 THEN 2 WHEN r / m <= 5 THEN 5 ELSE 10 END) AS DOUBLE) AS step FROM (SELECT p_partkey, r, pow(10.0, floor(log10(r))) AS m FROM (SELECT p_partkey, greatest(p_retailprice, 1) / 5.0 AS r FROM part))")
def tick_steps(spark, d):
    return load(spark, d, "part").select("p_partkey", X.tick_step("p_retailprice").alias("step"))


# -- files and notes ------------------------------------------------------------------------

LISTED = f"SELECT path, CAST(doc_id % 50 AS DOUBLE) AS mtime, doc_id FROM ({CHUNKS})"


@query(f"SELECT path, mtime FROM ({LISTED}) WHERE path LIKE 'digest/%' ORDER BY mtime DESC, path LIMIT 30")
def file_listing(spark, d):
    return files.listing(derive(spark, d, LISTED), "digest", 30, extensions=["md"]).select("path", "mtime")


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 2), chr(10)) AS head FROM documents WHERE text <> '' AND text <> chr(10)")
def read_lines(spark, d):
    docs = load(spark, d, "documents").where("text <> '' AND text <> '\n'")
    return docs.select("doc_id", F.array_join(F.slice(X.lines("text"), 1, 2), "\n").alias("head"))


@query(r"SELECT doc_id, replace(text, 'the', 'THE') AS body, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS replaced FROM documents")
def edit_body(spark, d):
    return notes.edit(load(spark, d, "documents").select("doc_id", F.col("text").alias("body")), "the", "THE").select("doc_id", "body", *big("replaced"))


@query(f"SELECT target_path, count(DISTINCT source_path) AS sources, count(*) AS links FROM ({LINKS}) l WHERE (target_path = 'n/1' OR target_path LIKE 'n/1/%') AND source_path <> 'n/1' GROUP BY target_path")
def delete_report(spark, d):
    return notes.delete_report(the_graph(spark, d)[0], "n/1")


NAMED = f"SELECT split_part(path, '/', 2) AS day, path, doc_id, lang FROM ({CHUNKS}) WHERE path LIKE 'daily/%'"


@query(f"SELECT day, count(*) AS n, string_agg('- [[' || path || ']] name: ' || doc_id || ' lang: ' || lang, chr(10) ORDER BY path) AS block FROM ({NAMED}) GROUP BY day")
def day_index_blocks(spark, d):
    rows = derive(spark, d, f"SELECT path, doc_id, lang FROM ({CHUNKS})").withColumn("fields", F.create_map(F.lit("lang"), "lang", F.lit("name"), F.col("doc_id").cast("string"), F.lit("session_id"), F.lit("s")))
    return notes.day_blocks(notes.notes_of_days(rows))


@query(f"SELECT day, '<!-- notes:auto -->' || chr(10) || count(*) || chr(10) || '<!-- /notes:auto -->' || chr(10) AS body FROM ({NAMED}) GROUP BY day")
def day_index_bodies(spark, d):
    rows = derive(spark, d, f"SELECT path FROM ({CHUNKS})")
    counted = notes.notes_of_days(rows).groupBy("day").agg(F.count("*").cast("string").alias("n"))
    return counted.select("day", notes.spliced(notes.spliced(F.lit(""), F.lit("old")), F.col("n")).alias("body"))


FIELDS = "SELECT doc_id, lang, source FROM documents"


@query(f"SELECT doc_id, 'xx' AS lang, source, 'new' AS extra FROM ({FIELDS})")
def frontmatter_update(spark, d):
    had = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    fields = notes.update_fields(had, F.create_map(F.lit("lang"), F.lit("xx"), F.lit("extra"), F.lit("new")))
    return derive(spark, d, FIELDS).select("doc_id", fields.alias("f")).select("doc_id", *[F.col("f")[k].alias(k) for k in ("lang", "source", "extra")])


@query(f"SELECT doc_id, source, 'lang' AS deleted, 'none' AS missing FROM ({FIELDS})")
def frontmatter_delete(spark, d):
    had = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    out = notes.delete_fields(had, F.array(F.lit("lang"), F.lit("none"))).alias("o")
    return derive(spark, d, FIELDS).select("doc_id", out).select("doc_id", F.col("o.fields")["source"].alias("source"), F.array_join("o.deleted", ",").alias("deleted"), F.array_join("o.missing", ",").alias("missing"))


@query("SELECT page_id, regexp_replace(url, '([?&](?:token|api_key)=)[^&#]*', '\\1***', 'g') AS url FROM pages".replace("\\\\", "\\"))
def redacted_urls(spark, d):
    return load(spark, d, "pages").select("page_id", X.redacted_url("url").alias("url"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.2f KiB', n_chars / 1024.0) ELSE printf('%.2f MiB', n_chars / 1048576.0) END AS size FROM documents")
def human_sizes(spark, d):
    return load(spark, d, "documents").select("doc_id", X.human_bytes("n_chars").alias("size"))


@query(f"SELECT DISTINCT path FROM ({CHUNKS}) WHERE path = 'digest' OR path LIKE 'digest/%'")
def allowed_paths(spark, d):
    return derive(spark, d, CHUNKS).where(X.allowed_path("path", ["digest", "~/x"])).select("path").distinct()


# -- seen state ------------------------------------------------------------------------------

ASKED = f"SELECT CAST(conv_id % 7 AS STRING) AS context_id, CAST(conv_id * 100 + turn AS BIGINT) AS rank, concat(path, '#', CAST(turn AS STRING)) AS id, path, start_line, end_line, turn FROM ({RANGES})"
GIVEN = f"SELECT context_id, id, path, start_line, end_line, CAST(CASE WHEN turn = 0 THEN 10 ELSE 90 END AS DOUBLE) AS ts FROM ({ASKED}) WHERE turn < 2"


@query(f"SELECT context_id, id, row_number() OVER (PARTITION BY context_id ORDER BY rank) AS place FROM ({ASKED}) a WHERE NOT EXISTS (SELECT 1 FROM ({GIVEN}) g WHERE g.context_id = a.context_id AND g.id = a.id AND 100 - g.ts < 50) QUALIFY place <= 20")
def seen_ids(spark, d):
    return seen_state.unseen_ids(derive(spark, d, ASKED), derive(spark, d, GIVEN), 100, 50, 20).select("context_id", "id", *big("place"))


LIVE = f"SELECT context_id || '|' || path AS path, start_line, end_line FROM ({GIVEN}) WHERE 100 - ts < 50"


@query(f"SELECT context_id, id, CAST(row_number() OVER (PARTITION BY context_id ORDER BY rank) AS INTEGER) AS place FROM ({ASKED}) a WHERE NOT EXISTS (SELECT 1 FROM ({MERGED.format(rows=LIVE)}) m WHERE m.path = a.context_id || '|' || a.path AND m.start_line <= a.start_line AND a.end_line <= m.end_line) QUALIFY place <= 20")
def seen_ranges(spark, d):
    return seen_state.unseen_ranges(derive(spark, d, ASKED), derive(spark, d, GIVEN), 100, 50, 20).select("context_id", "id", "place")


# -- extensions -------------------------------------------------------------------------------


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark, d):
    counted = change_feed.windowed_counts(load(spark, d, "events"), "ts", "event_type", width="1 hour")
    return counted.select(F.unix_micros(F.col("window_start").cast("timestamp")).alias("window_start"), "event_type", "n")


@query()
def hash_embeddings(spark, d):
    return load(spark, d, "benchmark").select("item_id", llm_columns.hash_embedding(F.col("text"), 16).alias("embedding"))


assert set(ORACLES) <= set(QUERIES) and tables.NAMES and fusion.K == 60
