"""Deterministic sharded WARC writer, and a reader.

Records are sorted by page id over ranges whose ends come from exact byte counts, so equal pages give equal shards on every
run. Rows without an id, and those of one id with more bytes than a shard, are dealt out further by a hash of the payload. A shard's
task writes gzip members, one per record, with headers and digests made anew from the page alone; it rolls to a new file when the
compressed size reaches a limit. Files are written under temporary names and renamed when they are complete; their list is
written as a manifest table once all are there, and readers open only what the manifest lists. A task that is lost and run
again finds the files that it had renamed: equal ones stay, others are replaced. What lost tasks leave under temporary names goes when the
manifest is there.

Of pages with equal payloads (by SHA-256 and size) of at least `least` bytes the one with the smallest id is the response; the
others are revisits, whose block keeps the response's HTTP headers only.

Defined results: null html is an empty payload; a null url gives a record without target URI; a null page id sorts before all others
and never is the response that others refer to unless all equal payloads have null ids (then each is a response); of rows with equal ids and
payloads the first is a response and the others revisit it (rows that are equal in all share a shard); other columns are ignored; an empty table gives a manifest of no files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, delete, scratch_dir

#: Payload bytes of a shard, compressed bytes of a file, cells of the histogram of ids.
SHARD_BYTES, FILE_BYTES, CELLS = 24 << 20, 32 << 20, 1 << 14
#: Compressed bytes that a task reads back; fewer where there are idle cores.
READ_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard long, file string, n_bytes long, n_records long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string"
FULL_RECORDS = RECORDS + ", payload binary"
NONE = -(1 << 63)
#: What reading back must give, in DuckDB: the digest's base 32 comes from pairs of its hexadecimal digits.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (
  SELECT page_id, octet_length(encode(h)) AS n, concat(sha1(h), '0') AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p
), g AS (SELECT *, list_transform(range(41), lambda i: strpos('0123456789abcdef', x[i + 1]) - 1) AS v FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (((v[1 + i * 5 // 4] * 16 + v[2 + i * 5 // 4]) >> (3 - i * 5 % 4)) & 31)]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Of a folder that Spark names: file:, hdfs:, s3a:, gs: or a plain path."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: str, k: int, shard: int | None = None) -> str:
    """k tells rows of equal ids and payloads apart, which one shard holds; without an id it is the shard's number too."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{k}' + ('' if shard is None else f':{shard}'))}>"


def headers(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    clean = lambda v: "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in v)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {clean(v)}" for k, v in fields if v is not None), f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, k: int, refers: tuple[int | None, str | None] | None, shard: int | None = None) -> bytes:
    """A response, or a revisit of the page (id, url) that it refers to."""
    digest = base32(hashlib.sha1(payload).digest())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Record-ID", record_id(page_id, digest, k, shard)), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("Page-ID", None if page_id is None else str(page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers is None:
        return headers("response", fields, http + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers[0], digest, 0)), ("WARC-Refers-To-Target-URI", refers[1]), ("WARC-Refers-To-Date", DATE), ("Refers-To-Page-ID", None if refers[0] is None else str(refers[0]))]
    return headers("revisit", fields, http)


def range_ends(sizes: DataFrame, target: int) -> tuple[np.ndarray, dict[int, int]]:
    """Ends of ranges of page ids that hold about `target` bytes each, and the bytes of the ids that have more by themselves (each is a range).
    sizes: page_id, n. Ranges are halved by equal-width cells; at most about CELLS counts come to the driver for each level."""
    lowest, highest = sizes.agg(F.min("page_id"), F.max("page_id")).first()
    if lowest is None:
        return np.zeros(0, np.int64), {}
    edges, fixed = [lowest, highest + 1], {}
    while True:
        spans = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a not in fixed and b - a > 1 or not fixed]
        if not spans:
            break
        each = max(2, CELLS // len(spans))
        cells = sorted({a + (b - a) * i // each for a, b in spans for i in range(each + 1)})
        lows = np.array(cells, np.int64)

        def count(batches: Iterator[pa.RecordBatch], lows: np.ndarray = lows) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(lows), np.int64)
            for batch in batches:
                place = np.searchsorted(lows, batch.column("page_id").to_numpy(), "right") - 1
                n = batch.column("n").to_numpy()
                np.add.at(total, place[place >= 0], n[place >= 0])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

        held = {r["cell"]: r["n"] for r in sizes.where("page_id IS NOT NULL").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
        inside = set()
        for a, b in spans:
            inside.update(range(int(np.searchsorted(lows, a)), int(np.searchsorted(lows, b))))
        for i in inside:
            if held.get(i, 0) <= target or cells[i + 1] - cells[i] == 1:
                fixed[cells[i]] = held.get(i, 0)
        edges = sorted({*edges, *cells})
        if all(a in fixed for a in edges[:-1]):
            break
    ends, total = [], 0
    for a in edges[:-1]:
        if total and total + fixed[a] > target:
            ends.append(a)
            total = 0
        total += fixed[a]
    return np.array(ends, np.int64), {a: n for a, n in fixed.items() if n > target}


def settle(fs: pafs.FileSystem, temp: str, name: str, size: int, sha256: str) -> None:
    """Renames a complete file. Where an earlier attempt at the task has left its file, an equal one stays; not all file systems rename
    onto a file that is there."""
    there = fs.get_file_info(name)
    if there.type == pafs.FileType.File:
        same = there.size == size
        if same:
            digest = hashlib.sha256()
            with fs.open_input_stream(name, compression=None) as stream:
                while part := stream.read(1 << 20):
                    digest.update(part)
            same = digest.hexdigest() == sha256
        if same:
            fs.delete_file(temp)
            return
        fs.delete_file(name)
    fs.move(temp, name)


def write(pages: DataFrame, out: str, least: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, level: int = 6) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files under out, and returns the manifest as written."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    sizes = rows.select("page_id", (F.octet_length("html") + 1).cast("long").alias("n"))
    ends, heavy = range_ends(sizes, shard_bytes)
    lost = sizes.where("page_id IS NULL").agg(F.sum("n")).first()[0] or 0
    # shards are numbered in the order of their ids; those that split an id or the rows without one come after all ranges
    first, parts = len(ends) + 1, {}
    for i, n in [(NONE, lost), *sorted(heavy.items())]:
        parts[i] = (first, max(1, -(-n // shard_bytes)))
        first += parts[i][1]
    split, starts, counts = np.array(list(parts), np.int64), *(np.array(x, np.int64) for x in zip(*parts.values(), strict=True))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By id, and where that isn't enough by the payload's hash."""
        for batch in batches:
            ids = batch.column("page_id").fill_null(NONE).to_numpy()
            k = np.minimum(np.searchsorted(split, ids), len(split) - 1)
            part = starts[k] + (batch.column("hash").to_numpy().view(np.uint64) % counts[k].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.where(split[k] == ids, part, np.searchsorted(ends, ids, "right")))], names=[*batch.schema.names[:-1], "shard"])

    hashed = F.xxhash64("html").alias("hash")
    keyed = rows.select("page_id", "url", F.sha2("html", 256).alias("sha"), F.octet_length("html").alias("n"), hashed).where(F.col("n") >= least)
    first_of = keyed.where("page_id IS NOT NULL").groupBy("sha", "n").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("times"))
    # A row with a null id has no id to be matched by but its payload, so its page_id says nothing here
    again = keyed.join(first_of, ["sha", "n"]).where("page_id IS NULL OR page_id > first.page_id OR times > 1").select("page_id", "sha", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), "hash").distinct()
    again = again.mapInArrow(deal, "page_id long, sha string, first_id long, first_url string, shard long")

    def run(key: tuple, own: pa.Table, seen: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        refers = {(p, s): (f, u) for p, s, f, u in zip(*(seen.column(c).to_pylist() for c in ("page_id", "sha", "first_id", "first_url")), strict=True)}
        order = sorted(range(own.num_rows), key=lambda i: (own.column("page_id")[i].as_py() is not None, own.column("page_id")[i].as_py() or 0, own.column("url")[i].as_py() or ""))
        fs, folder = filesystem(out)
        files, attempt, times = [], uuid.uuid4().hex, {}
        sink, digest, size, records, temp = None, None, 0, 0, ""

        def put(raw: bytes) -> None:
            nonlocal size, records
            member = gzip.compress(raw, level, mtime=0)
            sink.write(member)
            digest.update(member)
            size += len(member)
            records += 1

        def finish() -> None:
            sink.close()
            name = f"part-{shard:07d}-{len(files):04d}.warc.gz"
            settle(fs, temp, f"{folder}/{name}", size, digest.hexdigest())
            files.append((shard, name, size, records, digest.hexdigest()))

        for i in order:
            page_id, url, payload = own.column("page_id")[i].as_py(), own.column("url")[i].as_py(), own.column("html")[i].as_py().encode()
            if sink is None:
                temp = f"{folder}/.writing-{attempt}-{len(files)}"
                sink, digest, size, records = fs.open_output_stream(temp, compression=None), hashlib.sha256(), 0, 0
                put(headers("warcinfo", [("WARC-Record-ID", record_id(None, f"info:{shard}", len(files))), ("WARC-Date", DATE), ("WARC-Filename", f"part-{shard:07d}-{len(files):04d}.warc.gz"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            sha = hashlib.sha256(payload).hexdigest()
            k = times[page_id, sha] = times.get((page_id, sha), -1) + 1
            found = refers.get((page_id, sha))
            if found is not None and found[0] == page_id and k == 0:
                found = None
            put(page_record(page_id, url, payload, k, found, shard if page_id is None else None))
            if size >= file_bytes:
                finish()
                sink = None
        if sink is not None:
            finish()
        columns = list(zip(*files, strict=True)) or [[]] * 5
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.string())], names=["shard", "file", "n_bytes", "n_records", "sha256"])

    fs, folder = filesystem(out)
    fs.create_dir(folder, recursive=True)
    dealt = rows.select("*", hashed).mapInArrow(deal, "page_id long, url string, html string, shard long")
    dealt.groupBy("shard").cogroup(again.groupBy("shard")).applyInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{out}/_manifest")
    for info in fs.get_file_info(pafs.FileSelector(folder)):
        if info.base_name.startswith(".writing-"):
            fs.delete_file(info.path)
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{out}/_manifest")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    rest = b""
    while True:
        rest = rest or stream.read(1 << 20)
        if not rest:
            return
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest and not (rest := stream.read(1 << 20)):
                raise ValueError("the last gzip member is cut off")
            out.append(inflate.decompress(rest))
            rest = inflate.unused_data
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block; digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or f"sha1:{base32(hashlib.sha1(block).digest())}" != fields["warc-block-digest"]:
        raise ValueError(f"record {fields.get('warc-record-id')} is damaged")
    return fields, block


def read(spark: SparkSession, out: str, payloads: bool = False) -> DataFrame:
    """The page records of the files that the manifest lists; payloads: with those of responses."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")
    n, size = manifest.agg(F.count("*"), F.sum("n_bytes")).first()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-(size or 0) // READ_BYTES))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(out)
        for name in (name for batch in batches for name in batch.column("file").to_pylist()):
            rows, held = [], 0
            with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                for raw in members(stream):
                    fields, block = parse(raw)
                    if fields["warc-type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                    if fields["warc-type"] == "response" and (len(payload) != size or f"sha1:{base32(hashlib.sha1(payload).digest())}" != fields["warc-payload-digest"]):
                        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
                    number = lambda key, fields=fields: int(fields[key]) if key in fields else None
                    row = [number("page-id"), size, fields["warc-payload-digest"][5:], fields["warc-type"], number("refers-to-page-id"), fields.get("warc-target-uri"), name]
                    rows.append([*row, payload if fields["warc-type"] == "response" else None] if payloads else row)
                    held += size if payloads else 1
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("payload", pa.binary())][: len(rows[0])]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    return manifest.select("file").repartition(tasks).mapInArrow(run, FULL_RECORDS if payloads else RECORDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages to a new folder under the shared one, and reads the archives back; then the folder goes."""
    spark = pages.sparkSession
    out = f"{scratch_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, out, least)
    found = cut(read(spark, out))
    delete(spark, out)
    return found
