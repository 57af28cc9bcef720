from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions import vectors as V
from quillspark.operators import ann, bm25, changes, evaluation, filters, fusion, graph, intervals, keyword_index, messages, notes, ranking, topics, vector
from quillspark.plans import llm_columns, queries, search


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# -- retrieval -------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [("high", "apple apple apple pie"), ("mid", "apple apple tart cream"), ("low", "apple cake with cream"), ("none", "nothing here"), ("empty", ""), ("zh", "苹果 派"), ("one", "a b c")]
    return spark.createDataFrame(texts, "doc_id string, text string")


def test_bm25_orders_and_limits(spark, corpus):
    best = [r["doc_id"] for r in bm25.top_k(bm25.score_texts(corpus, "apple"), 10).collect()]
    assert best == ["high", "mid", "low"]
    assert [r["doc_id"] for r in bm25.top_k(bm25.score_texts(corpus, "APPLE apple pie"), 1).collect()] == ["high"]
    assert bm25.top_k(bm25.score_texts(corpus, "unknown"), 5).collect() == [] == bm25.top_k(bm25.score_texts(corpus, "apple"), 0).collect()
    assert [r["doc_id"] for r in bm25.top_k(bm25.score_texts(corpus, "果"), 5).collect()] == ["zh"]
    assert bm25.query_terms("The the 苹果 a x1") == ["苹", "果", "the", "x1"] and bm25.query_terms("the cat", ["the"]) == ["cat"]


def test_bm25_index_agrees_and_is_kept(spark, corpus, tmp_path):
    index = bm25.postings(corpus)
    stats = bm25.corpus_stats(index).first()
    assert (stats["n_docs"], stats["total_len"]) == (5, 17)
    direct = {r["doc_id"]: round(r["score"], 9) for r in bm25.score_texts(corpus, "apple cream").where("score > 0").collect()}
    assert {r["doc_id"]: round(r["score"], 9) for r in bm25.score_index(index, bm25.corpus_stats(index), ["apple", "cream"]).collect()} == direct
    less = bm25.without_docs(index, spark.createDataFrame([("high",)], "doc_id string"))
    assert bm25.corpus_stats(less).first()["n_docs"] == 4
    more = bm25.with_docs(index, spark.createDataFrame([("mid", "pear"), ("new", "pear pie")], "doc_id string, text string"))
    assert rows(more.where("token = 'pear'"), "doc_id", "tf", "dl") == [("mid", 1, 1), ("new", 1, 2)] and more.where("doc_id = 'mid' AND token = 'apple'").count() == 0
    assert rows(bm25.indexable(corpus), "doc_id") == [("high",), ("low",), ("mid",), ("none",), ("zh",)]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [1.0]), (5, None)], "id int, embedding array<float>")
    assert [r["id"] for r in vector.top_k(df, [1.0, 0.0], 2, "id").collect()] == [1, 3]
    assert rows(vector.missing_vectors(df, 2), "id") == [(4,), (5,)]
    old = spark.createDataFrame([("a", "t", [1.0, 2.0]), ("b", "t", [1.0])], "id string, text string, embedding array<float>")
    new = spark.createDataFrame([("a", "t"), ("a2", "t"), ("b", "t")], "id string, text string").withColumn("embedding", F.lit(None).cast("array<float>"))
    assert rows(vector.reuse_vectors(new, old, 2), "id", "embedding") == [("a", [1.0, 2.0]), ("a2", None), ("b", None)]
    a, b = vector.content_digest(df, "id").first(), vector.content_digest(df.orderBy(F.desc("id")).repartition(3), "id").first()
    assert a == b != vector.content_digest(df.where("id < 5"), "id").first()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_cells_find_the_neighbours(spark, sf):
    """The registered search's own parameters, over all queries, against brute force."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    x = {r["vec_id"]: np.array(r["embedding"], float) / np.linalg.norm(np.array(r["embedding"], float)) for r in rows.collect()}
    ids = np.array(sorted(x))
    matrix = np.stack([x[i] for i in ids.tolist()])
    hit = n = 0
    got = {}
    for r in queries.vector_approximate(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for i in ids[ids % 50 == 0].tolist():
        s = matrix @ x[i]
        true = set(ids[np.lexsort((ids, -s))[:10]].tolist())
        assert [k for k, _ in sorted(got[i])] == list(range(1, 11))
        hit, n = hit + len(true & {v for _, v in got[i]}), n + 10
    assert hit / n >= 0.9


def test_cells_of_odd_rows(spark, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(ann, "SMALL", 10)
    monkeypatch.setattr(ann, "PART", 40)
    good = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [1.0]), (1003, [None] * 8), (1004, [float("nan")] * 8), (1005, good[7][1]), (1006, [1e300] * 8), (1007, [])]
    df = spark.createDataFrame([(*r, "x") for r in good + odd], "id long, embedding array<double>, cell string")
    cells = ann.fit(df, 8)
    assert 1 < len(cells.centres) and cells.recall >= 0.95
    asked = df.where("id % 20 = 0 OR id >= 1000")
    exact = ann.search(ann.index(df, cells), asked, cells, 5, probes=99)
    found = {}
    for r in exact.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    unit = {i: np.array(v) / 1e300 if i == 1006 else np.array(v) for i, v in good + [odd[5], odd[6]]}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    assert set(found) == {*range(0, 300, 20), 1000 + 5, 1000 + 6}
    for q, own in found.items():
        want = sorted(unit, key=lambda i: (-round(float(unit[i] @ unit[q]), 12), i))[:5]
        assert [i for _, i in sorted(own)] == want
    assert ann.measured(ann.search(ann.index(df, cells), asked, cells, 5), exact) >= 0.9
    none = df.where("false")
    assert ann.search(ann.index(none, ann.fit(none, 8)), asked, ann.fit(none, 8), 5).collect() == []


def test_a_kept_index(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "BUCKET_ROWS", 4)
    monkeypatch.setattr(keyword_index, "FILE_ROWS", 2)
    monkeypatch.setattr(keyword_index, "MOST_CHANGES", 3)
    index = keyword_index.KeywordIndex(spark, str(tmp_path / "i"))
    assert not index.fits()
    index.build(corpus)
    found = lambda q, k=5: [(r["doc_id"], round(r["score"], 9)) for r in index.search(q, k).collect()]

    def fresh(docs, q):
        return [(r["doc_id"], round(r["score"], 9)) for r in bm25.top_k(bm25.score_texts(docs, q), 5).collect()]

    assert index.fits() and index.state()[1] > 1
    for q in ("apple", "cream pie", "苹果", "unknown", "", "apple apple"):
        assert found(q) == fresh(corpus, q)
    plan = index.scores("apple")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    now = corpus
    for k in range(3):
        index.delete(spark.createDataFrame([("high",)] if k == 1 else [("nobody",)], "doc_id string"))
        new = spark.createDataFrame([("mid", f"pear cream {'apple ' * k}"), (f"n{k}", "pie")], "doc_id string, text string")
        index.upsert(new)
        now = now.where("doc_id <> 'high'") if k == 1 else now
        now = now.join(new, "doc_id", "left_anti").unionByName(new)
        assert len(index.folders()) <= 5
        for q in ("apple", "cream pie"):
            assert found(q) == fresh(now, q)
    index.optimize(now)
    assert len(index.folders()) == 1 and found("apple pie") == fresh(now, "apple pie")
    index.delete(now.select("doc_id"))
    assert found("apple") == [] and index.state()[2:] == (0, 0)
    index.upsert(now)
    other = keyword_index.KeywordIndex(spark, str(tmp_path / "i"), stopwords=["apple"])
    assert not other.fits()
    with pytest.raises(ValueError):
        other.upsert(now)
    other.optimize(now)
    assert other.fits() and other.search("apple", 5).collect() == [] and len(other.search("cream", 5).collect()) > 0


def test_cosine_pairs_in_blocks_over_tasks(spark, monkeypatch):
    """Values and nulls are those of the column function, over several blocks of queries; a small table in one file is dealt out to tasks."""
    monkeypatch.setattr(vector, "ASKED", 3)
    monkeypatch.setattr(vector, "PAIRS", 8)
    odd = [[0.0, 0.0, 0.0], [], None, [1.0, None, 2.0], [1.0, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 0.0]]
    some = odd + [x.tolist() for x in np.random.default_rng(3).normal(size=(12, 3))]
    df = spark.createDataFrame([(f"v{i}", x) for i, x in enumerate(some)] + [(None, [1.0, 2.0, 3.0]), ("v1", [3.0, 2.0, 1.0])], "name string, e array<float>").coalesce(1)
    got = vector.cosine_pairs(df, df, "name", "e")
    assert got.rdd.getNumPartitions() > 8
    want = df.select(F.col("name").alias("query_id"), F.col("e").alias("q")).join(df).select("query_id", "name", V.cosine("e", "q").alias("score"))
    shown = lambda x: sorted((str(r["query_id"]), str(r["name"]), str(r["score"] if r["score"] is None else round(r["score"], 9) + 0.0)) for r in x.collect())
    assert shown(got) == shown(want) and len(shown(got)) == 441 and got.dtypes == want.dtypes
    assert vector.cosine_pairs(df, df.where("false"), "name", "e").collect() == []


def test_a_kept_index_shuffles_no_postings(spark, tmp_path):
    """Nor does compaction, over words of 64 places that are gone in part."""
    docs = spark.createDataFrame([(i, f"apple {'pear ' * (i % 3)} w{i}") for i in range(300)] + [(300, ""), (301, None)], "doc_id long, text string").repartition(3, "doc_id")
    index = keyword_index.KeywordIndex(spark, str(tmp_path / "i"), id_type="long")
    plan = index.postings_of(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    index.build(docs)
    index.delete(docs.where("doc_id % 3 = 0").select("doc_id"))
    new = docs.where("doc_id % 3 = 1").select("doc_id", F.concat("text", F.lit(" plum")).alias("text"))
    index.upsert(new)
    index.upsert(new.where("doc_id < 40"))
    now = docs.where("doc_id % 3 = 2").unionByName(new)
    want = {r["doc_id"]: round(r["score"], 9) for r in bm25.score_texts(now, "pear plum").where("score > 0").collect()}
    got = lambda: {r["doc_id"]: round(r["score"], 9) for r in index.scores("pear plum").collect()}
    assert got() == want and len(want) == 200
    moved = index._rows()._jdf.queryExecution().executedPlan().toString()
    assert "left_outer" in moved.lower() or "leftouter" in moved.lower()
    assert "SortMergeJoin" not in moved and "ShuffledHashJoin" not in moved
    index.compact()
    assert got() == want and index.documents().count() == 200 and len(index.folders()) == 1


def test_a_kept_index_is_smaller_than_its_texts(spark, tmp_path, monkeypatch):
    """A posting has its place alone; and a split of more postings than a task should sort becomes several tasks, at the build, a change and compaction."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").coalesce(1).cache()
    docs.write.parquet(str(tmp_path / "texts"))
    size = lambda path: sum(p.stat().st_size for p in path.rglob("*.parquet"))
    index = keyword_index.KeywordIndex(spark, str(tmp_path / "i"), id_type="long")
    index.build(docs)
    assert size(tmp_path / "i") < 0.6 * size(tmp_path / "texts")
    monkeypatch.setattr(keyword_index, "FILE_ROWS", 1 << 10)
    monkeypatch.setattr(keyword_index, "TASK_ROWS", 1 << 14)
    monkeypatch.setattr(keyword_index, "BUCKET_ROWS", 1 << 14)
    for dealt in (docs, docs.coalesce(1), docs.repartition(2, "doc_id"), spark.read.parquet(str(tmp_path / "texts"))):
        per_task = [r["count"] for r in index.postings_of(dealt, "doc_id", "text").groupBy(F.spark_partition_id()).count().collect()]
        assert len(per_task) > 4 and max(per_task) < sum(per_task) / 3
    index.build(docs)
    assert index.documents().count() == docs.where(F.size(X.tokens("text")) > 0).count()
    index.delete(docs.where("doc_id % 3 = 0").select("doc_id"))
    new = docs.where("doc_id % 3 = 1").select("doc_id", F.concat("text", F.lit(" that that")).alias("text"))
    index.upsert(new)
    want = {r["doc_id"]: round(r["score"], 9) for r in bm25.score_texts(docs.where("doc_id % 3 = 2").unionByName(new), "the that").where("score > 0").collect()}
    got = lambda: {r["doc_id"]: round(r["score"], 9) for r in index.scores("the that").collect()}
    assert got() == want and len(want) > 100
    monkeypatch.setattr(keyword_index, "TASK_ROWS", 1 << 10)
    index.compact()
    assert got() == want and len(index.folders()) == 1
    docs.unpersist()


def test_fusion(spark):
    v = spark.createDataFrame([("shared", 0.9, 1), ("v2", 0.8, 2)], "id string, score double, rank int")
    k = spark.createDataFrame([("k1", 9.0, 1), ("shared", 8.0, 2)], "id string, score double, rank int")
    fused = fusion.fuse(v, k, 0.5).orderBy(*fusion.fused_order()).collect()
    assert [r["id"] for r in fused] == ["shared", "k1", "v2"] and fused[0]["score"] == pytest.approx(0.5 / 61 + 0.5 / 62)
    tie = fusion.fuse(v.where("rank = 1"), k.where("rank = 1"), 0.5).orderBy(*fusion.fused_order()).collect()
    assert [r["id"] for r in tie] == ["shared", "k1"]


@pytest.fixture(scope="module")
def chunks(spark):
    data = [(f"c{i}", f"{'digest/wiki' if i % 2 else 'daily/2024-01-0' + str(1 + i % 5)}/n{i % 4}.md", i, i + 1, f"{'apple ' * (i % 3)}text number{i}", [float(i), 1.0], {"lang": "en" if i % 2 else "de"}) for i in range(10)]
    return spark.createDataFrame(data, "id string, path string, start_line int, end_line int, text string, embedding array<float>, metadata map<string,string>")


def test_hybrid_search(spark, chunks):
    got = search.hybrid(chunks, "apple", [1.0, 0.0], 4).collect()
    assert len(got) == 4 and [r["rank"] for r in got] == [1, 2, 3, 4] and all(r["score"] < 0.05 for r in got)
    only = search.hybrid(chunks, "apple", [1.0, 0.0], 4, vector_weight=1).collect()
    assert all(r["score"] == r["vector"] and r["keyword"] is None for r in only)
    assert search.hybrid(chunks, "zebra", [1.0, 0.0], 3).collect()[0]["score"] > 0.9  # no keyword hit: the vectors' own scores
    assert search.hybrid(chunks, "apple", None, 3).collect()[0]["keyword"] > 0
    assert search.hybrid(chunks, "apple", [1.0, 0.0], 3, min_score=1.0).collect() == []
    inside = search.hybrid(chunks, "apple", [1.0, 0.0], 9, search_filter={"lang": "en"}, start_date="2024-1-1", strict_date_filter=True).collect()
    assert inside == [] and len(search.hybrid(chunks, "apple", [1.0, 0.0], 9, start_date="2024-01-03").collect()) > 4
    first = search.hybrid(chunks, "apple", [1.0, 0.0], 2)
    again = search.hybrid(chunks, "apple", [1.0, 0.0], 2, seen=first)
    assert not {r["id"] for r in first.collect()} & {r["id"] for r in again.collect()}
    for bad in ({"query": " "}, {"query": "a", "limit": 0}):
        with pytest.raises(ValueError):
            search.hybrid(chunks, bad["query"], [1.0, 0.0], bad.get("limit"))
    assert (search.weight_of("x"), search.weight_of(7), search.candidates(5), search.candidates(100), search.candidates(1, 0.1)) == (0.7, 1.0, 25, 200, 1)


def test_node_search_and_passages(spark, chunks):
    table = chunks.select("path").distinct().select("path", F.lit(" N ").alias("name"), F.lit(None).cast("string").alias("description"))
    got = search.nodes(chunks, table, "apple", [1.0, 0.0], 5).collect()
    assert {r["path"] for r in got} == {"digest/wiki/n1.md", "digest/wiki/n3.md"} and {r["name"] for r in got} == {"N"}
    talk = spark.createDataFrame([("a", "session/dialog/s.jsonl", 1, 2, "x apple\ny", [1.0, 0.0]), ("b", "session/dialog/s.jsonl", 2, 3, "y apple\nz", [1.0, 0.1]), ("c", "n.md", 1, 1, "apple", [0.0, 1.0])], "id string, path string, start_line int, end_line int, text string, embedding array<float>").withColumn("metadata", F.create_map().cast("map<string,string>"))
    got = search.passages(talk, "apple", [1.0, 0.0], 5).collect()
    assert [(r["path"], r["start_line"], r["end_line"], r["text"]) for r in got] == [("session/dialog/s.jsonl", 1, 3, "x apple\ny apple\nz\n"), ("n.md", 1, 1, "apple")]
    seen = spark.createDataFrame([("session/dialog/s.jsonl", 1, 1), ("session/dialog/s.jsonl", 2, 3)], "path string, start_line int, end_line int")
    assert [r["path"] for r in search.passages(talk, "apple", [1.0, 0.0], 5, seen_ranges=seen).collect()] == ["n.md"]
    short = search.passages(talk, "apple", [1.0, 0.0], 5, compress=lambda t: F.left(t, F.lit(2))).collect()
    assert [r["text"] for r in short] == ["x ", "ap"]
    links = spark.createDataFrame([("n.md", "m.md", "L1", 0)], "source_path string, target_path string, target_anchor string, idx int")
    said = search.answer(search.hybrid(talk, "apple", [0.0, 1.0], 1), links, spark.createDataFrame([("m.md", "M", "d")], "path string, name string, description string")).first()["answer"]
    assert said.startswith("========== n.md:1-1 [score=") and 'outlinks (1):\n    → m.md  name="M"  description="d"\n          via anchor=#L1' in said


def test_filters_take_missing_keys_for_none(spark, chunks):
    assert chunks.where(filters.predicate({"none": None})).count() == 10 == chunks.where(filters.predicate(None)).count()
    assert chunks.where(filters.predicate({"lang": ["en", None]})).count() == 5
    assert filters.normalized({"start_date": "x"}, end_date="2024-1-2") == {"end_date": "2024-01-02"}
    assert filters.normalized({"start_date": "2024-01-05"}, "2023-01-01", None, True) == {"start_date": "2024-01-05", "strict_date_filter": True}


def test_model_columns(spark):
    got = spark.createDataFrame([("One two. Three", "two")], "a string, b string").select(llm_columns.first_sentence(F.col("a")), llm_columns.contains_judge(F.col("a"), F.col("b")), F.size(llm_columns.hash_embedding(F.col("a"), 8))).first()
    assert tuple(got) == ("One two.", "yes", 8)
    assert llm_columns.named("model", "first_sentence") is llm_columns.first_sentence
    with pytest.raises(KeyError):
        llm_columns.named("model", "none")
    with pytest.raises(ValueError):
        llm_columns.register("model", "first_sentence")(lambda t: t)
    llm_columns.expose(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM chunk_default('abc')").collect()] == [(1, 1, "abc")]


# -- graph -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def web(spark):
    links = [("a", "b", None, 0), ("a", "c", "L1", 1), ("a", "c", "L2", 2), ("b", "d", None, 0), ("d", "a", None, 0), ("e", "a", None, 0), ("c", "ghost", None, 0)]
    nodes = [(p, p.upper(), f"about {p}") for p in "abcde"]
    return spark.createDataFrame(links, "source_path string, target_path string, target_anchor string, idx int"), spark.createDataFrame(nodes, "path string, name string, description string")


def test_scopes_and_neighbours(web):
    links, nodes = web
    assert [r["target_path"] for r in graph.outlinks(links, nodes, "a", "real").collect()] == ["b", "c", "c"]
    assert rows(graph.scoped(links, nodes, "virtual"), "target_path") == [("ghost",)]
    assert [r["source_path"] for r in graph.inlinks(links, nodes, "a").collect()] == ["d", "e"] and rows(graph.inbound_sources(links, "c")) == [("a",)]
    assert tuple(graph.counts(links, nodes).first()) == (5, 1, 7)
    got = graph.neighbours(links, "source_path", "target_path", 1).where("path = 'a'").collect()
    assert [(r["neighbour"], r["anchors"]) for r in got] == [("b", [])]
    with pytest.raises(ValueError):
        graph.scoped(links, nodes, "none")
    text = graph.render_expansion(graph.expand(nodes.where("path = 'a'"), links, nodes)).first()["lines"]
    assert text.split("\n") == ["  outlinks (2):", '    → b  name="B"  description="about b"', '    → c  name="C"  description="about c"', "          via anchor=#L1", "          via anchor=#L2", "  inlinks (2):", '    ← d  name="D"  description="about d"', '    ← e  name="E"  description="about e"']


def test_traverse_equals_a_plain_walk(spark):
    rng = random.Random(8)
    edges = {(f"n{rng.randrange(30)}", f"n{rng.randrange(36)}") for _ in range(60)}
    links = spark.createDataFrame([(a, b, None, 0) for a, b in edges], "source_path string, target_path string, target_anchor string, idx int")
    nodes = spark.createDataFrame([(f"n{i}", f"N{i}", None) for i in range(30)], "path string, name string, description string")
    for direction in ("forward", "backward", "both"):
        ways = {}
        for a, b in edges:
            if direction != "backward":
                ways.setdefault(a, set()).add((b, a, b))
            if direction != "forward":
                ways.setdefault(b, set()).add((a, a, b))
        depth, found, front = {"n1": 0, "zz": 0}, {}, ["n1", "zz"]
        for step in (1, 2, 3):
            new = []
            for here in front:
                for there, a, b in ways.get(here, ()):
                    found.setdefault((a, b), step)
                    if there not in depth:
                        depth[there] = step
                        new.append(there)
            front = new
        n, e = graph.traverse(links, nodes, ["n1", "zz", "n1"], 3, direction)
        assert {r["path"]: r["depth"] for r in n.collect()} == depth
        assert {(r["source_path"], r["target_path"]): r["depth"] for r in e.collect()} == found
        assert {r["path"] for r in n.where("NOT indexed").collect()} == {p for p in depth if p == "zz" or int(p[1:]) >= 30}
    n, e = graph.traverse(links, nodes, ["n1"], 0)
    assert n.count() == 1 and e.count() == 0


def test_snapshot(spark):
    nodes = spark.createDataFrame([("digest/wiki/a.md", "A", ""), ("digest/personal/b.md", "B", ""), ("daily/2024-01-01/c.md", "C", ""), ("daily/2024-01-01/unused.md", "U", ""), ("resource/r.md", "R", "")], "path string, name string, description string")
    links = spark.createDataFrame([("digest/wiki/a.md", "digest/personal/b.md", None), ("digest/wiki/a.md", "daily/2024-01-01/c.md", "L1"), ("daily/2024-01-01/c.md", "digest/wiki/a.md", None), ("digest/wiki/a.md", "resource/r.md", None), ("digest/wiki/a.md", "gone.md", None)], "source_path string, target_path string, target_anchor string")
    n, e = graph.snapshot(nodes, links)
    assert {r["id"] for r in n.collect()} == {"virtual:wiki", "virtual:personal", "virtual:procedure", "digest/wiki/a.md", "digest/personal/b.md", "daily/2024-01-01/c.md"}
    assert rows(e) == sorted([("digest/wiki/a.md", "digest/personal/b.md", None), ("digest/wiki/a.md", "daily/2024-01-01/c.md", "L1"), ("virtual:wiki", "digest/wiki/a.md", None), ("virtual:personal", "digest/personal/b.md", None)], key=str)


# -- ranges and changes --------------------------------------------------------------


def test_ranges(spark):
    rng = random.Random(3)
    data = [("p" + str(rng.randrange(3)), a, a + rng.randrange(6)) for a in (rng.randrange(60) for _ in range(60))]
    df = spark.createDataFrame(data, "path string, start_line int, end_line int")
    want = []
    for p in ("p0", "p1", "p2"):
        out = []
        for _, a, b in sorted(r for r in data if r[0] == p):
            if out and a <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        want += [(p, a, b) for a, b in out]
    assert rows(intervals.merge(df, "path")) == sorted(want, key=str)
    asked = spark.createDataFrame([("p", 5, 15, 1), ("p", 15, 25, 2), ("q", 1, 1, 3)], "path string, start_line int, end_line int, rank int")
    seen = spark.createDataFrame([("p", 1, 10, 100.0), ("p", 11, 20, 100.0), ("p", 20, 30, 1.0)], "path string, start_line int, end_line int, ts double")
    assert rows(intervals.uncovered(asked, intervals.live(seen, 110, 50), "path"), "rank") == [(2,), (3,)]
    assert rows(intervals.uncovered(asked, seen, "path"), "rank") == [(3,)]
    order = spark.createDataFrame([("b", 9, 1), ("a", 1, 2), ("b", 2, 3)], "path string, start_line int, rank int")
    assert [(r["path"], r["start_line"]) for r in intervals.by_path(order).collect()] == [("b", 2), ("b", 9), ("a", 1)]


def test_union_of_passages(spark):
    df = spark.createDataFrame([("s", 1, 2, "a\nb\n", 0.1), ("s", 2, 3, "B\nc", 0.9), ("s", 4, 4, "d", 0.2), ("s", 7, 7, "own", 0.3)], "path string, start_line int, end_line int, text string, score double")
    assert rows(intervals.union_passages(df, "path")) == [("s", 1, 4, "a\nB\nc\nd\n", 0.9), ("s", 7, 7, "own", 0.3)]


def test_changes(spark):
    now = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "path string, mtime double")
    was = spark.createDataFrame([("b", 2.0), ("c", 1.0), ("d", 1.0)], "path string, mtime double")
    assert rows(changes.diff(now, was)) == [("a", "added"), ("c", "modified"), ("d", "deleted")]
    events = spark.createDataFrame([("a", "deleted"), ("a", "added"), ("b", "added"), ("x", "modified"), ("c", "odd")], "path string, change string")
    assert rows(changes.coalesce(events, now)) == [("a", "modified"), ("b", "added"), ("x", "deleted")]
    assert tuple(changes.consistency(now, was, "path").first()) == (1, 1)
    small, large = changes.by_size(spark.createDataFrame([("a", 5), ("b", 50)], "path string, length long"), 10)
    assert rows(small, "path") == [("a",)] and rows(large, "path") == [("b",)]
    files = spark.createDataFrame([(f"f{i}", 10) for i in range(250)], "path string, length long")
    assert changes.batches(files).select("batch").distinct().count() == 3
    days = spark.createDataFrame([("daily/2024-01-01.md", 1.0), ("daily/2024-01-01/x.md", 2.0), ("daily/2024-01-01/interests.yaml", 1.0), ("daily/2024-01-09/x.md", 1.0)], "path string, mtime double")
    had = spark.createDataFrame([("daily/2024-01-01.md", 1.0), ("daily/2024-01-01/x.md", 1.0), ("daily/2024-01-01/gone.md", 1.0), ("daily/2024-01-01/interests.yaml", 0.0)], "path string, mtime double")
    assert rows(changes.window_diff(days, had, ["2024-01-01"], topic_files=days)) == [("daily/2024-01-01.md", "unchanged"), ("daily/2024-01-01/gone.md", "deleted"), ("daily/2024-01-01/x.md", "changed")]


# -- notes ----------------------------------------------------------------------------


def test_notes(spark):
    df = spark.createDataFrame([("daily/2024-01-01/b.md", "---\nname: B\nx: 1\nsession_id: s\n---\nsee [[a.md#L1]] and [[a.md]]\n"), ("daily/2024-01-01/a.md", "---\nname: A\ndescription: |\n  two\n  lines\n---\n"), ("daily/2024-01-01/sub/c.md", "x"), ("a.md", "me")], "path string, text string")
    blocks = notes.day_blocks(notes.notes_of_days(notes.parsed(df)))
    assert rows(blocks) == [("2024-01-01", 2, "- [[daily/2024-01-01/a.md]] name: A description: two lines \n- [[daily/2024-01-01/b.md]] name: B x: 1")]
    none = spark.createDataFrame([], "day string, fields map<string,string>, body string")
    first = notes.day_indexes(blocks, none).first()
    assert first["created"] and first["fields"] == {"name": "2024-01-01", "description": "2 note(s) today."}
    again = notes.day_indexes(blocks, spark.createDataFrame([("2024-01-01", {"name": "mine", "k": "v"}, "top\n\n" + first["body"] + "end")], "day string, fields map<string,string>, body string")).first()
    assert again["fields"] == {"name": "mine", "k": "v", "description": "2 note(s) today."} and again["body"] == "top\n\n" + first["body"] + "end" and not again["created"]
    assert rows(notes.inbound_counts(df, "a.md")) == [("daily/2024-01-01/b.md", 2)] and rows(notes.inbound_counts(df, "a.md", "other")) == []
    moved = {r["path"]: r["text"] for r in notes.move(df, "a.md", "z/a.md").collect()}
    assert "z/a.md" in moved and "[[z/a.md#L1]] and [[z/a.md]]" in moved["daily/2024-01-01/b.md"]
    body = notes.edit(spark.createDataFrame([("aXaX",)], "body string"), "X", "y").first()
    assert (body["body"], body["replaced"]) == ("ayay", 2)
    back = notes.rendered(notes.parsed(df.where("path LIKE '%b.md'"))).first()["text"]
    assert back.startswith("---\nname: B\n") and back.endswith("[[a.md]]\n")
    fields = spark.range(1).select(notes.written_fields(F.create_map(F.lit("name"), F.lit("p"), F.lit("k"), F.lit("v"), F.lit("z"), F.lit(None).cast("string")), F.lit(" n"), F.lit(" ")).alias("f")).first()["f"]
    assert fields == {"name": "n", "k": "v"}


def test_links_that_lead_nowhere_become_text(spark):
    df = spark.createDataFrame([("r.md", "a [[x/y_z.md]] b [[gone/my_note.md|its name]] c [[gone/my_note.md]] d [[../e.md]] e [[r.md]]"), ("n.md", "plain"), ("m.md", None)], "path string, text string")
    got = {r["path"]: r["text"] for r in notes.validated_links(df, spark.createDataFrame([("x/y_z.md",), ("r.md",)], "path string")).collect()}
    assert got == {"r.md": "a [[x/y_z.md]] b its name c my note d e e r", "n.md": "plain", "m.md": None}


def test_names_and_deletions(spark):
    wanted = spark.createDataFrame([("d", "n", "s1"), ("d", "n", "s2"), ("d", "free", "s3")], "day string, name string, source string")
    got = {r["source"]: r["unique_name"] for r in notes.unique_names(wanted, spark.createDataFrame([("d", "n")], "day string, name string")).collect()}
    assert got["s3"] == "free" and got["s1"] != got["s2"] and all(got[s].startswith("n--") for s in ("s1", "s2"))
    links = spark.createDataFrame([("a", "f/x"), ("f/y", "f/x"), ("b", "f/x"), ("b", "g")], "source_path string, target_path string")
    assert rows(notes.delete_report(links, "f")) == [("f/x", 2, 2)]


# -- conversations ---------------------------------------------------------------------


def test_merge_and_append(spark):
    old = spark.createDataFrame([("s", "1", "a", "t1", 0), ("s", "2", "b", "t2", 1)], "session string, id string, text string, created_at string, line_no int")
    new = spark.createDataFrame([("s", "2", "B", "t2", 0), ("s", "3", "c", "t3", 1)], "session string, id string, text string, created_at string, line_no int")
    merged = messages.merge(old, new, "session")
    assert [(r["id"], r["text"]) for r in merged.orderBy("place").collect()] == [("1", "a"), ("2", "B"), ("3", "c")]
    assert messages.can_append(old.withColumn("place", F.col("line_no")), merged, "session").first()["append"]
    early = messages.merge(old, new.withColumn("created_at", F.lit("t0")), "session")
    assert not messages.can_append(old.withColumn("place", F.col("line_no")), early, "session").first()["append"]
    assert rows(messages.new_rows(new, old, "id"), "id") == [("3",)]


def test_segments_equal_a_plain_fold(spark):
    rng = random.Random(5)
    talk = [(c, i, rng.choice(["user", "assistant", "assistant"]), " ".join(["w"] * rng.randrange(9))) for c in range(12) for i in range(rng.randrange(1, 25))]
    want = {}
    for c in range(12):
        turns, own = [], [t for t in talk if t[0] == c]
        for t in own:
            if t[2] == "user" or not turns:
                turns.append([])
            turns[-1].append(t)
        at = begin = used = 0
        for turn in turns:
            w = sum(len(t[3].split()) for t in turn)
            if at > begin and used + w > 20:
                begin, used = at, 0
            for t in turn:
                want[c, t[1]] = begin
            used += w
            at += len(turn)
    df = spark.createDataFrame(talk, "c int, i int, role string, text string")
    assert {(r["c"], r["i"]): r["segment"] for r in messages.segments(df, "c", "i", 20).collect()} == want
    assert messages.segments(df, "c", "i", 0).where("segment <> 0").count() == 0


def test_times(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", i, base + dt.timedelta(hours=4 * i) if i in (1, 3) else None) for i in range(5)], "k string, i int, at timestamp")
    got = [r["filled_at"].hour for r in messages.interpolated(df, "k", "i", "at").orderBy("i").collect()]
    assert got == [4, 4, 8, 12, 12]
    assert messages.interpolated(df.where("at IS NULL"), "k", "i", "at").where("filled_at IS NOT NULL").count() == 0
    late = spark.createDataFrame([("s", "2024-01-01 20:00:00")], "s string, t string").withColumn("created_at", F.to_timestamp("t"))
    assert str(messages.day_of(late, "s", zone="Asia/Shanghai").first()["day"]) == "2024-01-02"
    names = ["created_at", "timestamp", "metadata"]
    t = spark.createDataFrame([(None, "x", None), ("", "", {"createdAt": "y"}), ("z", "x", None)], "created_at string, timestamp string, metadata map<string,string>")
    assert [r["t"] for r in t.select(messages.first_time(names, metadata="metadata").alias("t")).collect()] == ["x", "y", "z"]


def test_contents(spark):
    block = "type string, text string, name string, input string, source_type string"
    df = spark.createDataFrame([([("text", " hi ", None, None, None), ("tool_use", None, "grep", '{"a":1}', None), ("tool_result", "r" * 600, None, None, None), ("data", None, None, None, "base64"), ("thinking", "no", None, None, None), ("text", " ", None, None, None)],)], f"content array<struct<{block.replace(' string', ':string')}>>")
    row = df.select(messages.rendered_content(F.col("content")).alias("r"), messages.last_text(F.col("content")).alias("l"), F.size(messages.clean_content(F.col("content"))).alias("n")).first()
    assert row["r"].startswith('hi\n[tool grep({"a":1})]\n[tool_result rrr') and row["r"].endswith("...]") and row["l"] == " hi " and row["n"] == 4
    talk = spark.createDataFrame([("user", "hi"), ("assistant", " "), ("system", "x"), ("user", "<system-reminder>x</system-reminder>")], "role string, text string")
    assert rows(messages.spoken(talk), "text") == [("hi",)]


def test_pairs_and_records(spark):
    left = spark.createDataFrame([("t", "m1", 100.0), ("t", "m2", 110.0), ("u", "m3", 0.0)], "task string, id string, at double")
    right = spark.createDataFrame([("t", "r1", 108.0), ("t", "r2", 90.0), ("u", "r3", 99999.0)], "task string, id string, at double")
    assert rows(messages.nearest_pairs(left, right, "task", 6 * 3600)) == [("t", "m1", "r1"), ("t", "m2", "r2")]
    turns = spark.createDataFrame([("a", 0), ("a", 1)], "s string, turn int")
    records = spark.createDataFrame([("a", 1, 2, "y"), ("a", 1, 1, "x")], "s string, turn int, seq int, name string")
    assert [[x["name"] for x in r["records"] or []] for r in messages.attach_records(turns, records, "s").orderBy("turn").collect()] == [[], ["x", "y"]]
    chat = spark.createDataFrame([(1, "", [[("user", "a", "March-15-2024")], [("user", "b", None)]]), (2, None, [[("user", "c", None)]])], "batch_number int, time_anchor string, turns array<array<struct<role:string,content:string,time_anchor:string>>>")
    assert [(r["session"], r["content"], str(r["created_at"])[:10]) for r in messages.anchored_sessions(chat).orderBy("session", "place").collect()] == [(1, "a", "2024-03-15"), (1, "b", "2024-03-15"), (2, "c", "2024-01-01")]
    zipped = spark.createDataFrame([(["x", "y"], ["2023/05/20 (Sat) 02:21", "2023/05/19 (Fri) 02:21"], ["m", "n"])], "i array<string>, d array<string>, m array<string>")
    assert [r["session_id"] for r in messages.zipped_sessions(zipped, "i", "d", "m").collect()] == ["y", "x"]


# -- topics, lists, evaluation --------------------------------------------------------------


def test_topics(spark):
    allowed = spark.createDataFrame([("a.md",), ("b.md",)], "path string")
    units = spark.createDataFrame([(1, "N", "odd", "s", ["a.md", "x", "a.md"]), (2, " ", "wiki", "s", ["a.md"]), (3, "M", "personal", "s", []), (4, "P", "procedure", "t", ["b.md"])], "ordinal int, name string, bucket string, summary string, paths array<string>")
    assert rows(topics.clean_units(units, allowed), "name", "bucket", "paths") == [("N", "wiki", ["a.md"]), ("P", "procedure", ["b.md"])]
    assert topics.clean_units(units, allowed, 1).count() == 1
    t = spark.createDataFrame([(1, "Big Idea"), (2, "big idea!"), (3, "Old"), (4, "New"), (5, "")], "ordinal int, title string")
    same, recent = spark.createDataFrame([(0, "First")], "ordinal int, title string"), spark.createDataFrame([(0, "OLD")], "ordinal int, title string")
    assert [r["title"] for r in topics.dedupe_topics(t, same, recent, 3).orderBy("place").collect()] == ["First", "Big Idea", "New"]
    assert topics.recent_dates("2024-03-01", 2) == ["2024-02-29", "2024-03-01"] and topics.previous_dates("2024-03-01", 2) == ["2024-02-29", "2024-02-28"] and topics.recent_dates("x", 2) == ["x"]
    actions = spark.createDataFrame([("UPDATE", "wiki", "digest/wiki/a.md"), ("UPDATE", "wiki", "digest/wiki/no.md"), ("CREATE", "wiki", "digest/personal/x.md"), ("CREATE", "wiki", "digest/wiki/x.md"), ("CREATE", "wiki", "../x.md"), ("CREATE", "wiki", "a/b.md")], "action string, bucket string, target string")
    got = {(r["action"], r["target"]): r["problem"] for r in topics.checked_targets(actions, spark.createDataFrame([("digest/wiki/a.md",)], "path string")).collect()}
    assert [k for k, v in got.items() if v is None] and {k[1] for k, v in got.items() if v is None} == {"digest/wiki/a.md", "digest/wiki/x.md"}
    packed = {r["path"]: r["block"] for r in topics.packed_texts(spark.createDataFrame([("a", "x" * 9)], "path string, text string"), spark.createDataFrame([("a",), ("b",)], "path string"), 4).collect()}
    assert packed == {"a": "### a\nxxxx\n\n[truncated]\n\n", "b": "### b\n(file not found)\n"}


def test_papers_and_news(spark):
    item = spark.createDataFrame([('{"paper": {"id": "2401.00001v2", "title": "T", "upvotes": 3}}',), ('{"id": "2401.00002", "title": "U"}',), ('{"id": "bad"}',)], "j string").select(ranking.paper_of(F.col("j")).alias("p")).collect()
    assert [None if r["p"] is None else (r["p"]["arxiv_id"], r["p"]["title"], r["p"]["upvotes"]) for r in item] == [("2401.00001", "T", 3), ("2401.00002", "U", 0), None]
    page = spark.range(1).select(ranking.ids_in_page(F.lit('<a href="/papers/2401.00002">x</a><a href="/papers/2401.00001"><a href="/papers/2401.00002">')).alias("x")).first()["x"]
    assert page == ["2401.00002", "2401.00001"]
    m = spark.createDataFrame([("a", "", 5, 1), ("b", "B", 1, 2)], "arxiv_id string, title string, upvotes int, rank int")
    w = spark.createDataFrame([("a", "A", 9, 1), ("c", "C", 2, 2)], "arxiv_id string, title string, upvotes int, rank int")
    best = ranking.candidates(ranking.merge_lists(m, w), spark.createDataFrame([("b",)], "arxiv_id string")).collect()
    assert [(r["arxiv_id"], r["title"], r["upvotes"]) for r in best] == [("a", "A", 9), ("c", "C", 2)] and best[0]["fused_score"] == pytest.approx(1.7 / 61)
    raw = spark.createDataFrame([("1", "100", "<p>T</p>", "", "c", 0), ("1", "101", "later", "", "c", 1), ("x", "100", "t", "", "", 2), ("2", "999", "t", "", "", 3), ("3", "200", "", "", "", 4), ("4", "100", "", "brief", "", 5)], "id string, ctime string, title string, brief string, content string, page_order int")
    got = ranking.news_window(ranking.news_rows(raw), F.timestamp_seconds(F.lit(100)), F.timestamp_seconds(F.lit(200))).collect()
    assert [(r["news_id"], r["title"], r["content"]) for r in got] == [("1", "T", "c"), ("4", "brief", "brief")]
    many = spark.createDataFrame([(i, "x" * 2000) for i in range(120)], "i int, text string")
    assert [r["count"] for r in ranking.numbered_batches(many, 50, "i").groupBy("batch").count().orderBy("batch").collect()] == [50, 50, 20]
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-04",)], "t string").withColumn("t", F.to_timestamp("t"))
    assert [r["n"] for r in ranking.date_spine(days, "t").orderBy("day").collect()] == [1, 0, 0, 1]


def tau(x, y):
    c = d = tx = ty = 0
    n = len(x)
    for i in range(n):
        for j in range(i + 1, n):
            a, b = x[j] - x[i], y[j] - y[i]
            tx += a == 0
            ty += b == 0
            c += a * b > 0
            d += a * b < 0
    n0 = n * (n - 1) / 2
    room = (n0 - tx) * (n0 - ty)
    return 0.0 if n < 2 or room <= 0 else (c - d) / room**0.5


def test_kendall_and_order(spark):
    rng = random.Random(2)
    groups = {str(k): [(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(0, 25))] for k in range(12)}
    df = spark.createDataFrame([(k, x, y) for k, v in groups.items() for x, y in v], "k string, x int, y int")
    got = {r["k"]: r["tau"] for r in evaluation.kendall(df, "k").collect()}
    assert got == {k: pytest.approx(tau([x for x, _ in v], [y for _, y in v])) for k, v in groups.items() if v}
    one = evaluation.order_score(spark.createDataFrame([("q", ["a", "b", "c"], ["a", "c", "x"])], "k string, reference array<string>, system array<string>"), "k").first()
    t = (tau([1, 2, 3, 5], [1, 5, 2, 3]) + 1) / 2
    assert one["precision"] == pytest.approx(2 / 3) and one["recall"] == pytest.approx(2 / 3) and one["final_score"] == pytest.approx(t * 2 / 3)
    pair = spark.createDataFrame([("q", ["r1", "r2"], ["s1", "s2", "s3"], [[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.1], [0.9, 0.0], [0.7, 0.7]])], "k string, reference array<string>, system array<string>, reference_vectors array<array<double>>, system_vectors array<array<double>>")
    assert evaluation.align_by_cosine(pair, "k").first()["aligned"] == ["r1", "s2", "s3"] or evaluation.align_by_cosine(pair, "k").first()["aligned"] == ["r1", "s2", "r2"]


def test_usage_and_counters(spark):
    use = spark.createDataFrame([("a", 5, None, None, 2), ("a", None, 3, 1, None), ("b", None, None, None, None)], "k string, input_tokens int, prompt_tokens int, output_tokens int, completion_tokens int")
    assert rows(evaluation.token_usage(use, "k")) == [("a", 8, 3, 11), ("b", None, None, None)]
    log = spark.createDataFrame([(["x", "y"], 2, 0), (["x"], 1, 1), (["x", "y"], 3, 2)], "path array<string>, delta int, seq int")
    assert rows(evaluation.counters(log)) == [(["x", "y"], 5), (["x"], 1)] and evaluation.subtree(evaluation.counters(log), ["x"]).count() == 2
    assert [r["previous"] for r in evaluation.previous_values(log).orderBy("seq").collect()] == [0, 0, 2]
    a, b = spark.createDataFrame([("k", 1), ("l", 1)], "k string, value int"), spark.createDataFrame([("k", 4), ("m", 1)], "k string, value int")
    assert rows(evaluation.counter_delta(a, b, "k")) == [("k", 3), ("l", None), ("m", None)]
    r = evaluation.rubric(spark.createDataFrame([("t", [1.0, 0.5], 0.75), ("t", [], 1.0)], "k string, scores array<double>, score double"), "k").first()
    assert (r["score"], r["binary_score"]) == (0.875, 0.75)
    assert rows(evaluation.table_sizes({"a": a, "u": use})) == [("a", 2), ("u", 3)]
