"""Writing notes, transcripts and topics."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_texts(texts: DataFrame, root: str, path: str = "path", text: str = "text") -> DataFrame:
    """Writes each row's text to its path under root, under a temporary name first; returns path and n_bytes. root: a folder that all
    executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)
        for batch in batches:
            sizes = []
            for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                target, raw = f"{base.rstrip('/')}/{p}", (t or "").encode()
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                temp = f"{target}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(temp) as out:
                    out.write(raw)
                fs.move(temp, target)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], names=["path", "n_bytes"])

    return texts.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(run, "path string, n_bytes long")


def session_lines(messages: DataFrame, session: str, order: str = "place") -> DataFrame:
    """path, text of session files, one JSON object a line. For sessions that fit into a row each."""
    fields = [c for c in messages.columns if c not in (session, order)]
    line = F.struct(F.col(order).alias("o"), F.to_json(F.struct(*fields)).alias("j"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(x["j"], F.lit("\n"))), "")
    return messages.groupBy(session).agg(text.alias("text")).select(F.concat(F.lit("session/dialog/"), F.col(session).cast("string"), F.lit(".jsonl")).alias("path"), "text")


def topic_files(topics: DataFrame, path: str = "path", order: str = "place") -> DataFrame:
    """path, text of YAML topic files from rows (path, place, title, reason, evidence, keywords, paths)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        said = sorted(rows.to_pylist(), key=lambda r: r["place"])
        items = [{k: r[k] for k in ("title", "reason", "evidence", "keywords", "paths")} for r in said]
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([yaml.safe_dump({"topics": items}, allow_unicode=True, sort_keys=False)], pa.string())], names=["path", "text"])

    rows = topics.select(F.col(path).alias("path"), F.col(order).cast("long").alias("place"), "title", "reason", "evidence", "keywords", "paths")
    return rows.groupBy("path").applyInArrow(run, "path string, text string")


def saved(fs_root: str, path: str, text: str, expected_mtime: float | None = None) -> bool:
    """Writes one text unless the file has changed since expected_mtime; tells whether it did."""
    fs, base = filesystem(fs_root)
    target = f"{base.rstrip('/')}/{path}"
    info = fs.get_file_info(target)
    if expected_mtime is not None and (info.type == pafs.FileType.NotFound or abs(info.mtime.timestamp() - expected_mtime) > 1e-3):
        return False
    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
    temp = f"{target}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp) as out:
        out.write(text.encode())
    fs.move(temp, target)
    return True
