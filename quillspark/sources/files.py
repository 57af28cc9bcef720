"""Files of a workspace as rows."""

from __future__ import annotations

import datetime as dt
import io
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import text as X

FILES = "path string, mtime double, length long, content binary"


@dataclass(frozen=True)
class Rule:
    """A folder that is looked at, and the suffixes (without the dot) of its files."""

    folder: str
    suffixes: tuple[str, ...]


def rules(settings: Mapping[str, str], names: Iterable[str], suffixes: Iterable[str]) -> list[Rule]:
    """Rules of folders: each name is a setting's (`daily_dir`), a setting's with a folder under it (`daily_dir/x`), or a path."""
    out = []
    for name in names:
        head, _, rest = name.partition("/")
        folder = "/".join(p.strip("/") for p in (settings[head], rest) if p.strip("/")) if head in settings else name.rstrip("/")
        rule = Rule(folder, tuple(s.lstrip(".") for s in suffixes))
        if rule not in out:
            out.append(rule)
    return out


def matches(path: X.Col, some: Iterable[Rule]) -> Column:
    """The path lies in a rule's folder and has one of its suffixes."""
    out = F.lit(False)
    for rule in some:
        ends = F.lit(not rule.suffixes)
        for s in rule.suffixes:
            ends = ends | X.col(path).endswith("." + s)
        out = out | (X.col(path).startswith(rule.folder.rstrip("/") + "/") & ends)
    return out


def scan(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True, content: bool = True, paths: Iterable[str] | None = None) -> DataFrame:
    """path (relative to root), mtime, length, content. Without content only the listing is read. paths: only these files (relative) are opened;
    one that is no longer there is left out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob)
    if paths is None:
        df = reader.load(root)
    else:
        # a name may hold what a glob takes for a pattern; and a pattern may match nothing, where a plain path must exist
        df = reader.option("ignoreMissingFiles", "true").load([f"{root.rstrip('/')}/{plain_glob(p)}" for p in paths])
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z0-9]+:/*", "/")
    path = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    return df.select(F.substring(path, F.length(base) + 2, F.length(path)).alias("path"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "length", *(["content"] if content else []))


def plain_glob(path: str) -> str:
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in path)


def texts(files: DataFrame, most: int | None = None) -> DataFrame:
    """path, st_mtime, text, encoding of scanned files; those over `most` bytes are left out."""
    rows = files if most is None else files.where(F.col("length") <= most)
    return rows.withColumn("d", A.decoded("content", X.suffix("path"))).select("path", F.col("mtime").alias("st_mtime"), "d.text", "d.encoding")


def listing(files: DataFrame, folder: str = "", limit: object = 100, recursive: bool = True, sort_by: str | None = "mtime", extensions: Iterable[str] = ()) -> DataFrame:
    """The folder's files, newest first and then by path, or by path alone; a bad limit is 100."""
    try:
        n = int(limit)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        n = 100
    rows = files.where(X.under("path", folder)) if folder else files
    if not recursive:
        rest = F.substring("path", F.lit(len(folder.rstrip("/")) + 2 if folder else 1), F.length("path"))
        rows = rows.where(F.instr(rest, "/") == 0)
    wanted = [e if e.startswith(".") else f".{e}" for e in extensions]
    rows = rows.where(X.suffix("path").isin([w.lower() for w in wanted])) if wanted else rows
    order = [F.desc("mtime"), "path"] if sort_by == "mtime" else ["path"]
    return rows.orderBy(*order).limit(n if n > 0 else 100)


def stat(files: DataFrame, nodes: DataFrame, path: str) -> DataFrame:
    """path, exists, type, size, mtime, mime, fields of one path; a folder comes before a file of the same name with `.md`."""
    inside = files.where(F.col("path").startswith(path.rstrip("/") + "/")).agg(F.count("*").alias("n"))
    own = files.where(F.col("path").isin(path, path + ".md")).orderBy(F.desc(F.col("path") == path)).limit(1)
    row = inside.join(own.select(F.col("path").alias("file"), "length", "mtime"), F.lit(True), "left")
    kind = F.when(F.col("n") > 0, "directory").when(F.col("file").isNotNull(), "file")
    named = row.select(F.coalesce(F.when(F.col("n") > 0, F.lit(path)), "file", F.lit(path)).alias("path"), kind.isNotNull().alias("exists"), kind.alias("type"), F.when(kind == "file", F.col("length")).alias("size"), F.when(kind == "file", F.col("mtime")).alias("mtime"), F.when(kind == "file", F.coalesce(X.image_type("file"), F.when(X.suffix("file") == ".md", "text/markdown").otherwise("application/octet-stream"))).alias("mime"))
    return named.join(nodes.select("path", "fields"), "path", "left")


def images(files: DataFrame, most: int = 5 << 20) -> DataFrame:
    """path, mime, length, base64 of images; large ones without their bytes."""
    return files.select("path", X.image_type("path").alias("mime"), "length", F.when(F.col("length") <= most, F.replace(F.base64("content"), F.lit("\r\n"), F.lit(""))).alias("base64")).where("mime IS NOT NULL")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """no, value of one text file's lines; only LF ends a line. Lines are numbered over all parts of the file without bringing them
    together: each part's count first, and then within it."""
    lines = spark.read.option("lineSep", "\n").text(path).withColumn("id", F.monotonically_increasing_id())
    part = F.shiftright("id", 33)
    before = lines.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    offsets = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    return lines.withColumn("part", part).join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("id").bitwiseAND((1 << 33) - 1) + 1).alias("no"), "value")


def line_range(lines: DataFrame, start: int, end: int, most_bytes: int = 100 * 1024) -> DataFrame:
    """no, value of lines start to end, as long as they hold most_bytes at most together."""
    picked = lines.where(F.col("no").between(start, end))
    used = F.sum(F.octet_length("value") + 1).over(Window.orderBy("no"))
    return picked.withColumn("used", used).where(F.col("used") - F.octet_length("value") - 1 < most_bytes).drop("used")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; what isn't one is null in all fields."""
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "PERMISSIVE").json(path)


def jsonl_zst(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same of files compressed with Zstandard, which are read as a stream: a task holds a compressed file and a megabyte of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True), "utf-8", newline="\n")
                while part := text.readlines(1 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array([line.rstrip("\n") for line in part], pa.string())], names=["line"])

    lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line string")
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def newest_session(files: DataFrame, session: str) -> DataFrame:
    """path of the newest `*/<session>.jsonl`."""
    return files.where(F.substring_index("path", "/", -1) == f"{session}.jsonl").agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def is_session(path: X.Col, folder: str = "session/dialog") -> Column:
    return X.normal_path(path).endswith(".jsonl") & X.under(X.normal_path(path), folder)


def rendered_session(lines: DataFrame) -> DataFrame:
    """no, line of a transcript's lines (no, value): who said what when, flattened; lines that aren't messages stay."""
    message = F.from_json("value", "name string, role string, created_at string, content string")
    said = X.flat_line(F.coalesce(F.nullif(F.col("m.name"), F.lit("")), "m.role", F.lit("unknown")), F.coalesce("m.created_at", F.lit("")), "said")
    blocks = F.from_json("m.content", "array<struct<type:string,text:string>>")
    text = F.coalesce(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), " "), "m.content")
    return lines.withColumn("m", message).withColumn("said", text).select("no", F.when(F.col("m.role").isNotNull(), said).otherwise(F.col("value")).alias("line"))


def day_files(files: DataFrame, day: str, daily: str = "daily", topics: str = "interests") -> DataFrame:
    """The day's index note and all notes in its folder, but for its topic file."""
    inside = (F.col("path") == f"{daily}/{day}.md") | (F.col("path").startswith(f"{daily}/{day}/") & F.col("path").endswith(".md"))
    return files.where(inside & (F.col("path") != f"{daily}/{day}/{topics}.yaml"))


def topics(files: DataFrame, strict: bool = False) -> DataFrame:
    """path, title, reason, evidence, keywords, paths of YAML topic files (path, text)."""
    return files.select("path", F.explode(A.yaml_topics(strict)("text")).alias("t")).select("path", "t.*")


def proactive(files: DataFrame, day: str, daily: str = "daily", name: str = "interests") -> DataFrame:
    """The day's topics; a file that isn't there gives none."""
    return topics(files.where(F.col("path") == f"{daily}/{day}/{name}.yaml"))


def now() -> float:
    return dt.datetime.now(dt.UTC).timestamp()
