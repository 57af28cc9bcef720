from __future__ import annotations

import json
import os
import random
import time

import pytest
import zstandard
from pyspark.sql import functions as F

from quillspark.operators.store import Store, build, catalog_delete, catalog_upsert
from quillspark.sources import config, files, writers
from quillspark.streaming import change_feed, seen

NOTE = "---\nname: {n}\ndescription: about {n}\n---\n# {n}\n\nlinks to [[daily/b.md#L2|x]] and [[gone.md]]\n"


def put(root, path, text):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture()
def workspace(tmp_path):
    root = tmp_path / "ws"
    put(root, "daily/a.md", NOTE.format(n="a"))
    put(root, "daily/b.md", NOTE.format(n="b"))
    put(root, "session/dialog/s.jsonl", '{"role": "user", "content": "hi", "created_at": "t"}\n')
    put(root, "c.json", json.dumps({"k": "v"}))
    put(root, "pic.png", b"\x89PNG")
    return root


RULES = [files.Rule("daily", ("md",)), files.Rule("session", ("jsonl",))]


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_scan_list_and_stat(spark, workspace):
    found = files.scan(spark, str(workspace))
    assert paths(found) == ["c.json", "daily/a.md", "daily/b.md", "pic.png", "session/dialog/s.jsonl"]
    assert paths(found.where(files.matches("path", RULES))) == ["daily/a.md", "daily/b.md", "session/dialog/s.jsonl"]
    assert paths(files.scan(spark, str(workspace), "*.md", content=False)) == ["daily/a.md", "daily/b.md"]
    assert files.rules({"daily_dir": "daily"}, ["daily_dir", "daily_dir/x", "/abs/"], [".md"]) == [files.Rule("daily", ("md",)), files.Rule("daily/x", ("md",)), files.Rule("/abs", ("md",))]
    assert [r["path"] for r in files.listing(found.withColumn("mtime", F.lit(1.0)), limit="x").collect()] == paths(found)
    assert [r["path"] for r in files.listing(found, recursive=False, sort_by=None).collect()] == ["c.json", "pic.png"]
    assert [r["path"] for r in files.listing(found, "daily", 1, extensions=["md"], sort_by=None).collect()] == ["daily/a.md"]
    nodes = build(files.texts(found.where("path LIKE '%.md'")))["nodes"]
    assert files.stat(found, nodes, "daily").first()["type"] == "directory"
    one = files.stat(found, nodes, "daily/a").first()
    assert (one["path"], one["type"], one["mime"], one["fields"]["name"]) == ("daily/a.md", "file", "text/markdown", "a")
    assert not files.stat(found, nodes, "no").first()["exists"]
    image = files.images(found).first()
    assert (image["mime"], image["base64"]) == ("image/png", "iVBORw==") and files.images(found, 2).first()["base64"] is None


def test_lines_and_sessions(spark, tmp_path):
    put(tmp_path, "x.txt", "".join(f"line {i} \n" for i in range(1, 501)))
    lines = files.numbered_lines(spark, str(tmp_path / "x.txt"))
    assert [r["no"] for r in lines.where(F.col("value").startswith("line 77")).collect()] == [77] and lines.count() == 500
    assert [r["no"] for r in files.line_range(lines, 10, 20, 25).orderBy("no").collect()] == [10, 11, 12]
    talk = spark.createDataFrame([(1, '{"role": "user", "name": "Ann", "content": [{"type": "text", "text": "hi\\n there"}], "created_at": "t"}'), (2, "not json"), (3, '{"role": "user", "content": "x"}')], "no long, value string")
    assert [r["line"] for r in files.rendered_session(talk).orderBy("no").collect()] == ["[Ann @ t] hi there", "not json", "[user @ ] x"]
    listed = spark.createDataFrame([("p/s.jsonl", 1.0), ("q/s.jsonl", 2.0), ("q/t.jsonl", 3.0)], "path string, mtime double")
    assert files.newest_session(listed, "s").first()["path"] == "q/s.jsonl"
    days = spark.createDataFrame([("daily/2024-01-01.md",), ("daily/2024-01-01/x/y.md",), ("daily/2024-01-01/interests.yaml",), ("daily/2024-01-02/z.md",)], "path string")
    assert paths(files.day_files(days, "2024-01-01")) == ["daily/2024-01-01.md", "daily/2024-01-01/x/y.md"]
    topics = spark.createDataFrame([("daily/2024-01-01/interests.yaml", "topics:\n- {title: T, reason: r}\n")], "path string, text string")
    assert [r["title"] for r in files.proactive(topics, "2024-01-01").collect()] == ["T"] and files.proactive(topics, "2024-01-02").collect() == []
    put(tmp_path, "r.jsonl", '{"a": 1}\nbad\n')
    assert [r["a"] for r in files.jsonl(spark, str(tmp_path / "r.jsonl"), "a int").collect()] == [1, None]


def test_compressed_lines(spark, tmp_path):
    raw = "".join(json.dumps({"a": i, "t": "é\u2028x" * 20}) + "\n" for i in range(5000))
    (tmp_path / "x.jsonl.zst").write_bytes(zstandard.compress(raw.encode()) + zstandard.compress(b'{"a": -1}\nbad'))
    got = files.jsonl_zst(spark, str(tmp_path / "x.jsonl.zst"), "a int, t string").collect()
    assert sorted(str(r["a"]) for r in got) == sorted([*map(str, range(-1, 5000)), "None"]) and {r["t"] for r in got if r["a"] is not None and r["a"] >= 0} == {"é\u2028x" * 20}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("d/a.md", "x"), ("d/e/b.md", None)], "path string, text string")
    assert sorted(tuple(r) for r in writers.write_texts(df, str(tmp_path)).collect()) == [("d/a.md", 1), ("d/e/b.md", 0)]
    assert (tmp_path / "d/a.md").read_text() == "x" and not [f for f in os.listdir(tmp_path / "d") if f.endswith(".tmp")]
    assert writers.saved(str(tmp_path), "d/a.md", "y") and not writers.saved(str(tmp_path), "d/a.md", "z", 1.0)
    assert writers.saved(str(tmp_path), "d/a.md", "z", (tmp_path / "d/a.md").stat().st_mtime) and (tmp_path / "d/a.md").read_text() == "z"
    talk = spark.createDataFrame([("s", 1, "b"), ("s", 0, "a")], "session string, place int, text string")
    assert tuple(writers.session_lines(talk, "session").first()) == ("session/dialog/s.jsonl", '{"text":"a"}\n{"text":"b"}\n')
    topics = spark.createDataFrame([("p.yaml", 1, "U", "r", "", [], []), ("p.yaml", 0, "T", "r", "e", ["k"], ["q"])], "path string, place int, title string, reason string, evidence string, keywords array<string>, paths array<string>")
    written = writers.topic_files(topics)
    assert [r["title"] for r in files.topics(written, strict=True).collect()] == ["T", "U"]


def test_config(tmp_path):
    put(tmp_path, "base.yaml", "a: {x: 1, y: 2}\nn: ${NAME:-none}\n")
    put(tmp_path, "top.yaml", "extends: base.yaml\na: {y: 3}\nlist: ['${HOME_X}']\n")
    got = config.load(str(tmp_path / "top.yaml"), {"a.z": "5", "flag": "true", "word": "text"})
    assert got == {"a": {"x": 1, "y": 3, "z": 5}, "n": "none", "list": ["${HOME_X}"], "flag": True, "word": "text"}
    assert config.expanded({"k": ["${A}"]}, {"A": "b"}) == {"k": ["b"]}


def test_store_keeps_and_replaces(spark, workspace, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.version() is None and store.read()["chunks"].count() == 0
    counts = change_feed.sync(store, str(workspace), RULES)
    assert counts == {"added": 3, "modified": 0, "deleted": 0}
    tables = store.read()
    assert paths(tables["nodes"]) == ["daily/a.md", "daily/b.md", "session/dialog/s.jsonl"]
    node = tables["nodes"].where("path = 'daily/a.md'").first()
    assert (node["name"], node["description"]) == ("a", "about a") and node["chunk_ids"] == [r["id"] for r in tables["chunks"].where("path = 'daily/a.md'").collect()]
    assert sorted((r["target_path"], r["target_anchor"]) for r in tables["links"].where("source_path = 'daily/a.md'").collect()) == [("daily/b.md", "L2"), ("gone.md", None)]
    assert "PartitionFilters: [isnotnull(layer" in tables["chunks"].where("layer = 'daily'")._jdf.queryExecution().toString()
    before = store.version()
    assert change_feed.sync(store, str(workspace), RULES) == {"added": 0, "modified": 0, "deleted": 0} and store.version() == before
    put(workspace, "daily/a.md", NOTE.format(n="a2"))
    os.utime(workspace / "daily/a.md", (1, 1))
    (workspace / "daily/b.md").unlink()
    put(workspace, "daily/d.md", "# d")
    assert change_feed.sync(store, str(workspace), RULES) == {"added": 1, "modified": 1, "deleted": 1}
    tables = store.read()
    assert paths(tables["nodes"]) == ["daily/a.md", "daily/d.md", "session/dialog/s.jsonl"] and tables["nodes"].where("name = 'a2'").count() == 1
    assert tables["links"].where("target_path = 'daily/b.md'").count() == 1  # it leads nowhere now
    store.delete(spark.createDataFrame([("daily/d.md",)], "path string"))
    assert tables["chunks"].count() - store.read()["chunks"].count() == 1
    store.clear()
    assert store.read()["nodes"].count() == 0
    old = spark.createDataFrame([("c", "a", 1.0), ("c", "b", 1.0)], "catalog string, path string, mtime double")
    new = spark.createDataFrame([("c", "b", 2.0), ("d", "a", 1.0)], "catalog string, path string, mtime double")
    assert catalog_upsert(old, new, "catalog", "path").count() == 3 and catalog_delete(old, new, "catalog", "path").count() == 1


def test_chunks_can_carry_fields(spark):
    df = spark.createDataFrame([("a.md", 1.0, "---\nname: n\nday: 2024-01-01\nempty: ''\n---\nbody"), ("b.txt", 1.0, "---\nname: n\n---\n")], "path string, st_mtime double, text string")
    meta = lambda keys: {r["path"]: r["metadata"] for r in build(df, fields_in_metadata=keys)["chunks"].collect()}
    assert meta(None) == {"a.md": {}, "b.txt": {}} and meta([])["a.md"] == {"name": "n", "day": "2024-01-01"} and meta(["day", "no"])["a.md"] == {"day": "2024-01-01"}


def test_follow_a_folder(spark, workspace, tmp_path):
    store, told = Store(spark, str(tmp_path / "store")), []
    for _ in range(2):
        change_feed.follow(store, str(workspace), str(tmp_path / "check"), RULES, seconds=None, told=lambda e, c: told.append(c)).awaitTermination()
    assert told[0]["added"] == 3 and len(store.read()["nodes"].collect()) == 3
    (workspace / "daily/a.md").unlink()
    put(workspace, "daily/new.md", "new")
    change_feed.follow(store, str(workspace), str(tmp_path / "check"), RULES, seconds=None, told=lambda e, c: told.append(c)).awaitTermination()
    assert told[-1] == {"added": 1, "modified": 0, "deleted": 1}


def until(holds, seconds=90):
    end = time.monotonic() + seconds
    while not holds():
        assert time.monotonic() < end
        time.sleep(0.3)


def test_a_live_stream_sees_edits_and_deletions(spark, workspace, tmp_path):
    """A rewrite, a deletion, and then both and a new file at about the same time, while the stream runs."""
    store, told = Store(spark, str(tmp_path / "store")), []
    query = change_feed.follow(store, str(workspace), str(tmp_path / "check"), RULES, seconds=1, told=lambda e, c: told.append(c))
    some = lambda: [c for c in told if any(c.values())]
    texts = lambda: " ".join(r["text"] for r in store.read()["chunks"].collect())
    try:
        until(lambda: len(some()) == 1)
        assert some()[0] == {"added": 3, "modified": 0, "deleted": 0}
        put(workspace, "daily/a.md", "rewritten [1]")
        until(lambda: len(some()) == 2)
        assert some()[1] == {"added": 0, "modified": 1, "deleted": 0} and "rewritten" in texts() and "about a" not in texts()
        (workspace / "daily/b.md").unlink()
        until(lambda: len(some()) == 3)
        assert some()[2] == {"added": 0, "modified": 0, "deleted": 1} and paths(store.read()["nodes"]) == ["daily/a.md", "session/dialog/s.jsonl"]
        put(workspace, "daily/a.md", "third")
        put(workspace, "daily/new [x].md", "named oddly")
        (workspace / "session/dialog/s.jsonl").unlink()
        until(lambda: sum(sum(c.values()) for c in some()[3:]) == 3)
        assert paths(store.read()["nodes"]) == ["daily/a.md", "daily/new [x].md"] and sorted(texts().split()) == ["named", "oddly", "third"]
    finally:
        query.stop()
    assert len(store.folders()) >= 3


def test_only_wanted_files_are_opened(spark, workspace, tmp_path, monkeypatch):
    store, opened = Store(spark, str(tmp_path / "store")), []
    change_feed.sync(store, str(workspace), RULES)
    real = files.scan
    monkeypatch.setattr(files, "scan", lambda *a, **k: (opened.append(k), real(*a, **k))[1])
    put(workspace, "daily/a{1}.md", "x")
    assert change_feed.sync(store, str(workspace), RULES)["added"] == 1
    assert [k.get("paths") for k in opened if k.get("content", True)] == [["daily/a{1}.md"]]
    assert store.read()["nodes"].where("path = 'daily/a{1}.md'").count() == 1
    monkeypatch.setattr(change_feed, "BY_NAME", 0)
    put(workspace, "daily/z.md", "z")
    assert change_feed.sync(store, str(workspace), RULES)["added"] == 1 and "daily/z.md" in paths(store.read()["nodes"])
    assert change_feed.reindex(store, str(workspace), RULES)["added"] == 5


def test_changes_are_compacted(spark, tmp_path, monkeypatch):
    from quillspark.operators import store as module

    monkeypatch.setattr(module, "MOST_CHANGES", 3)
    store = Store(spark, str(tmp_path / "store"))
    file = lambda path, text, at: spark.createDataFrame([(path, at, text)], "path string, st_mtime double, text string")
    for k in range(8):
        store.upsert(file(f"n/{k % 3}.md", f"text {k} [[n/{k}.md]]", float(k)))
        assert len(store.folders()) <= 5
    store.delete(file("n/1.md", "", 0.0))
    want = {"n/0.md": 6.0, "n/2.md": 5.0}
    for _ in range(2):
        tables = store.read()
        assert {r["path"]: r["st_mtime"] for r in tables["nodes"].collect()} == want
        assert sorted(r["target_path"] for r in tables["links"].collect()) == ["n/5.md", "n/6.md"] and tables["chunks"].count() == 2
        before = store.version()
        store.compact()
        assert len(store.folders()) == 1 and store.version() > before
    with pytest.raises(RuntimeError):
        monkeypatch.setattr(Store, "_pointers", lambda self: [])
        put(tmp_path, "store/state-000000000000", "x")
        store.write(store.read())


def test_events_are_coalesced_to_what_is_there(spark, tmp_path):
    put(tmp_path, "in/1.json", "\n".join(json.dumps({"path": p, "change": c}) for p, c in [("a", "deleted"), ("a", "added"), ("b", "added"), ("x", "modified")]))
    events = spark.readStream.schema("path string, change string").json(str(tmp_path / "in"))
    done = []
    here = spark.createDataFrame([("a",), ("b",)], "path string")
    change_feed.apply_events(events, lambda: here, lambda df, epoch: done.extend(tuple(r) for r in df.collect()), str(tmp_path / "c"), seconds=None).awaitTermination()
    assert sorted(done) == [("a", "modified"), ("b", "added"), ("x", "deleted")]
    said = []
    assert change_feed.log_changes(spark.createDataFrame([("a", "added")], "path string, change string"), said.append) == 1 and said == ["added: a"]


def test_supervision():
    class Query:
        def __init__(self, fails):
            self.fails = fails

        def awaitTermination(self):
            if self.fails:
                raise RuntimeError("lost")

    queue, pauses = [Query(True), Query(True), Query(True), Query(False)], []
    assert change_feed.supervised(lambda: queue.pop(0), sleep=pauses.append, rng=random.Random(1)) == 4
    assert all(0.5 * 2**i <= p <= 1.5 * 2**i for i, p in enumerate(pauses)) and len(pauses) == 3
    with pytest.raises(RuntimeError):
        change_feed.supervised(lambda: Query(True), tries=2, sleep=pauses.append)


ASKED = [("c", 1, 10.0, 1, "i1", "p", 1, 10, 5), ("c", 1, 10.0, 2, "i2", "p", 11, 20, 5), ("c", 1, 10.0, 3, "i3", "q", 1, 2, 2), ("c", 2, 20.0, 1, "i4", "p", 5, 15, 5), ("c", 2, 20.0, 2, "i1", "p", 15, 25, 5), ("c", 2, 20.0, 3, "i3", "q", 1, 2, 5), ("c", 3, 900.0, 1, "i1", "p", 1, 10, 5), ("d", 1, 10.0, 1, "i1", "p", 1, 10, 5)]
COLUMNS = "context_id string, request_id long, ts double, rank int, id string, path string, start_line int, end_line int, limit int"


@pytest.mark.parametrize("by_ranges", [True, False])
def test_seen_state_as_a_stream(spark, tmp_path, by_ranges):
    spark.createDataFrame(ASKED, COLUMNS).coalesce(1).write.parquet(str(tmp_path / "in"))
    asked = spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in"))
    name = f"seen_{by_ranges}"
    q = seen.returned_stream(asked, ttl=100, by_ranges=by_ranges).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["context_id"], r["request_id"], r["place"], r["id"]) for r in spark.table(name).collect())
    # the first request's limit is the largest that its rows name
    first = [("c", 1, 1, "i1"), ("c", 1, 2, "i2"), ("c", 1, 3, "i3")]
    second = [("c", 2, 1, "i1")] if by_ranges else [("c", 2, 1, "i4")]
    assert got == first + second + [("c", 3, 1, "i1"), ("d", 1, 1, "i1")]


def test_seen_state_as_tables(spark):
    asked = spark.createDataFrame(ASKED, COLUMNS).where("request_id = 1")
    empty = spark.createDataFrame([], "context_id string, id string, path string, start_line int, end_line int, ts double")
    given = seen.unseen_ranges(asked, empty, 10, 100, 2)
    assert sorted((r["context_id"], r["id"]) for r in given.collect()) == [("c", "i1"), ("c", "i2"), ("d", "i1")]
    held = seen.remember(given, empty, 10, 100)
    later = spark.createDataFrame(ASKED, COLUMNS).where("request_id = 2")
    assert [r["id"] for r in seen.unseen_ranges(later, held, 20, 100, 5).orderBy("rank").collect()] == ["i1", "i3"]
    assert [r["id"] for r in seen.unseen_ids(later, held, 20, 100, 5).orderBy("rank").collect()] == ["i4", "i3"]
    assert seen.unseen_ranges(later, held, 500, 100, 5).count() == 3


def test_event_time_extensions(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(src.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = change_feed.once(stream, "event_id", at="ts").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == src.count()
    assert change_feed.windowed_counts(src, "ts", "event_type", width="1 hour").agg(F.sum("n")).first()[0] == src.count()
    assert change_feed.rolling_news(src, "ts").count() > 0 and isinstance(change_feed.active(spark), list)
