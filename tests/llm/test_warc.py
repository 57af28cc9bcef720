from __future__ import annotations

import base64
import gzip
import hashlib
import os

import pytest

from quillspark.llm import warc

ROWS = [
    (5, "http://a/5", "<p>é</p>"), (3, "http://a/3", "<p>é</p>"), (9, None, None), (4, "http://a/4", ""), (7, "http://a/7\r\nX: y", "x" * 300_000), (8, "http://a/8", "short"),
    (8, "http://a/8", "short"), (11, "http://b", "short"), (None, "http://n", "only null"), (None, "http://n", "only null"), (None, "http://m", "short"), (2**62, "http://far", "far"), (12, "u", "a\r\n\r\nb\r\n\r\n"), (-3, "http://neg", "neg"),
]


def expected(rows, least):
    out, first, seen = [], {}, set()
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None:
            first[b] = min(first.get(b, p), p)
    for p, _, h in rows:
        b = (h or "").encode()
        response = len(b) < least or b not in first or (first[b] == p and (p, b) not in seen)
        seen.add((p, b))
        out.append((str(p), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else first[b]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, shard int")


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, tmp_path, least):
    warc.write(frame(spark, ROWS), str(tmp_path / "w"), least, shard_bytes=1000)
    got = warc.read(spark, str(tmp_path / "w"), payloads=True).collect()
    assert sorted([(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == expected(ROWS, least)
    payload = {(r["page_id"], r["payload_digest"]): bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    for p, _, h in ROWS:
        b = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert payload.get((p, d), b) == b
    names = [n for n in os.listdir(tmp_path / "w") if n.endswith(".gz")]
    assert len(names) >= 3 and not [n for n in os.listdir(tmp_path / "w") if n.startswith(".writing")]


def test_files_are_the_same_again_and_roll(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for name, parts in (("a", 3), ("b", 11)):
        warc.write(pages.repartition(parts), str(tmp_path / name), shard_bytes=200_000, file_bytes=20_000)
    read = lambda n: {f: (tmp_path / n / f).read_bytes() for f in os.listdir(tmp_path / n) if f.endswith(".gz")}
    a, b = read("a"), read("b")
    assert a == b and any("-0001." in f for f in a)
    for raw in a.values():
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    got = {r["page_id"]: r for r in warc.read(spark, str(tmp_path / "a")).collect()}
    assert len(got) == pages.count()
    order = [r["page_id"] for r in sorted(warc.read(spark, str(tmp_path / "a")).collect(), key=lambda r: r["page_id"])]
    by_file = {}
    for r in got.values():
        by_file.setdefault(r["file"], []).append(r["page_id"])
    assert [p for f in sorted(by_file) for p in sorted(by_file[f])] == order


def test_a_damaged_record_is_told(spark, tmp_path):
    warc.write(frame(spark, ROWS[:2]), str(tmp_path / "w"))
    raw = warc.page_record(1, "u", b"abc", 0, None)
    warc.parse(raw)
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"abc", b"abd"))


def test_an_empty_table(spark, tmp_path):
    warc.write(frame(spark, []), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).collect() == []


def test_rounds_trip_over_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    got = warc.round_trip(pages).collect()
    assert sorted([(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == expected(rows, 0)


def test_null_ids_and_one_heavy_id_are_split(spark, tmp_path):
    rows = [(None, f"http://n/{i}", "n" * 200 + str(i)) for i in range(60)] + [(5, f"http://h/{i}", "h" * 200 + str(i % 50)) for i in range(60)] + [(i, "u", "x" * 90) for i in range(6, 20)]
    manifest = warc.write(frame(spark, rows), str(tmp_path / "w"), shard_bytes=1000).collect()
    assert len(manifest) > 20 and max(r["n_records"] for r in manifest) < 25
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert sorted([(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == expected(rows, 0)


def test_a_task_that_runs_again_meets_its_files(spark, tmp_path):
    """A first attempt has renamed a file and left another half written; a file of another content is replaced."""
    out = tmp_path / "w"
    first = {r["file"]: r["sha256"] for r in warc.write(frame(spark, ROWS), str(out), shard_bytes=1000).collect()}
    names = sorted(first)
    (out / ".writing-lost-0").write_bytes(b"half")
    (out / names[1]).write_bytes(b"other")
    (out / names[2]).unlink()
    again = {r["file"]: r["sha256"] for r in warc.write(frame(spark, ROWS), str(out), shard_bytes=1000).collect()}
    assert again == first == {n: hashlib.sha256((out / n).read_bytes()).hexdigest() for n in names}
    assert not (out / ".writing-lost-0").exists()


def test_reading_takes_as_many_tasks_as_there_are_cores(spark, tmp_path):
    warc.write(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), str(tmp_path / "w"), shard_bytes=100_000)
    assert warc.read(spark, str(tmp_path / "w")).rdd.getNumPartitions() == 8


def test_the_round_trip_leaves_no_archive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "scratch_dir", lambda _: str(tmp_path))
    assert warc.round_trip(frame(spark, ROWS)).count() == len(ROWS) and os.listdir(tmp_path) == []
