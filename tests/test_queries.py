from __future__ import annotations

import hashlib
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from quillspark.operators import chunkers, notes
from quillspark.plans import row_queries  # noqa: F401  registers more
from quillspark.plans.queries import ORACLES, QUERIES

from .compare import connect, difference

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert difference(spark, con, name, QUERIES[name], ORACLES[name], SMALL) == ""


def test_queries_without_sql_are_these():
    """Approximate search is held to brute force in test_operators; the other two below."""
    assert set(QUERIES) - set(ORACLES) == {"vector_approximate", "chunk_markdown", "hash_embeddings"}


def test_chunks_of_markdown(spark):
    """Every document's chunks: in order, within the size, all words once and in order (those of a heading that leads a chunk aside), ids by rule."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {}
    for r in QUERIES["chunk_markdown"](spark, SMALL).collect():
        got.setdefault(int(r["path"][:-3]), []).append(r)
        assert r["id"] == hashlib.sha256(f"{r['path']} {r['start_line']} {r['end_line']} {r['text']}".encode()).hexdigest()
        assert len(r["text"].encode()) <= 10_000 or r["text"].count("\n\n") <= 4
    assert set(got) == set(docs)
    for i, text in docs.items():
        own = sorted(got[i], key=lambda r: r["chunk_index"])
        assert [r["chunk_index"] for r in own] == list(range(len(own))) and all(a["start_line"] <= b["start_line"] for a, b in zip(own, own[1:], strict=False))
        note = f"---\nname: x\n---\n# {text[:20]}\n\n{text}\n\n## More\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"
        assert [r["text"] for r in own] == [t for _, _, t in chunkers.by_markdown(note)]
        words = note.split("\n", 3)[3].split()
        said = [w for r in own for w in r["text"].split() if not (w == "[Part" or re.fullmatch(r"\d+/\d+\]", w))]
        left = Counter(words)
        left.subtract(said)
        assert not any(n > 0 for n in left.values())


def test_hashed_embeddings(spark):
    """Equal texts have equal vectors, all of length 1, and others differ."""
    texts = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    got = {r["item_id"]: r["embedding"] for r in QUERIES["hash_embeddings"](spark, SMALL).collect()}
    again = {r["item_id"]: r["embedding"] for r in QUERIES["hash_embeddings"](spark, SMALL).collect()}
    assert set(got) == set(texts) and got == again and all(len(v) == 16 for v in got.values())
    assert len({tuple(v) for v in got.values()}) == len(set(texts.values()))


def test_names_whose_hashes_are_equal(spark, tmp_path):
    """The sources s52997 and s245987 have one name, and hashes with the same 8 digits: the query is as its SQL, and the operator's names differ."""
    spark.createDataFrame([(i, "t") for i in (7, 77, 52997, 245987)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(spark, con, "unique_names", QUERIES["unique_names"], ORACLES["unique_names"], str(tmp_path)) == ""
    wanted = spark.createDataFrame([("7", "n7", "s52997"), ("7", "n7", "s245987")], "day string, name string, source string")
    got = {r["source"]: (r["suffixed"], r["unique_name"]) for r in notes.unique_names(wanted, wanted.select("day", "name")).collect()}
    assert got["s52997"][0] == got["s245987"][0] and got["s52997"][1] == got["s245987"][1] + "-2"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
