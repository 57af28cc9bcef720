"""The document store: nodes, links and chunks as partitioned Parquet, kept as a base and small changes to it.

A change is a folder with new rows and with the paths whose older rows it takes away, so an update writes what is new and nothing else.
After MOST_CHANGES of them the next write compacts all to a new base. Chunks are partitioned by layer (the first segment of their path), which turns prefix filters into partition pruning.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import text as X
from . import chunkers, graph
from .vector import reuse_vectors
from .versions import MOST_CHANGES, Versions

CHUNKS = "id string, path string, start_line int, end_line int, text string, embedding array<float>, metadata map<string,string>, layer string"
NODES = "path string, st_mtime double, name string, description string, fields map<string,string>, chunk_ids array<string>"
LINKS = "source_path string, target_path string, target_anchor string, idx int"
TABLES = {"chunks": CHUNKS, "nodes": NODES, "links": LINKS}


def build(files: DataFrame, kind: str | None = None, fields_in_metadata: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of files (path, st_mtime, text). fields_in_metadata: front-matter fields that chunks carry; an empty list stands for all."""
    is_note = F.lower("path").endswith(".md")
    parsed = files.withColumn("parsed", F.when(is_note, A.front_matter(F.when(is_note, F.col("text")).otherwise(F.lit("")))))
    fields = F.coalesce("parsed.fields", F.create_map().cast("map<string,string>"))
    notes = parsed.select("path", "st_mtime", "text", is_note.alias("is_note"), fields.alias("fields"), F.coalesce("parsed.body", "text").alias("body"))
    chunks = chunkers.chunk(notes, kind)
    if fields_in_metadata is None:
        chunks = chunks.withColumn("metadata", F.create_map().cast("map<string,string>"))
    else:
        kept = F.map_filter("fields", lambda k, v: v.isNotNull() & (v != "") & (k.isin(fields_in_metadata) if fields_in_metadata else F.lit(True)))
        chunks = chunks.join(notes.select("path", kept.alias("metadata")), "path")
    chunks = chunks.select("id", "path", "start_line", "end_line", "text", F.lit(None).cast("array<float>").alias("embedding"), "metadata", X.layer_of_path("path").alias("layer"), "chunk_index")
    ids = chunks.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id"))), lambda c: c["id"]).alias("chunk_ids"))
    nodes = notes.join(ids, "path", "left").select("path", "st_mtime", F.coalesce(F.col("fields")["name"], F.lit("")).alias("name"), F.coalesce(F.col("fields")["description"], F.lit("")).alias("description"), "fields", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))
    links = graph.extract_links(notes.where("is_note"), text="body")
    return {"chunks": chunks.drop("chunk_index"), "nodes": nodes, "links": links}


def without(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Tables without the nodes of some paths (path), their chunks and their own links. Links to them stay, and become virtual."""
    gone = paths.select("path").distinct()
    return {
        "chunks": tables["chunks"].join(gone, "path", "left_anti"),
        "nodes": tables["nodes"].join(gone, "path", "left_anti"),
        "links": tables["links"].join(gone.withColumnRenamed("path", "source_path"), "source_path", "left_anti"),
    }


def upserted(tables: dict[str, DataFrame], new: dict[str, DataFrame], dim: int | None = None) -> dict[str, DataFrame]:
    """Tables with new ones in the place of their nodes; vectors of unchanged chunks stay."""
    fresh = new["chunks"] if dim is None else reuse_vectors(new["chunks"], tables["chunks"], dim)
    rest = without(tables, new["nodes"])
    return {"chunks": rest["chunks"].unionByName(fresh), "nodes": rest["nodes"].unionByName(new["nodes"]), "links": rest["links"].unionByName(new["links"])}


class Store(Versions):
    """Tables under a folder."""

    def read(self) -> dict[str, DataFrame]:
        folders = self.folders()
        if not folders:
            return {name: self.spark.createDataFrame([], schema) for name, schema in TABLES.items()}
        load = lambda folder, name, schema: self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/{name}")
        if len(folders) == 1:
            return {name: load(folders[0], name, schema) for name, schema in TABLES.items()}
        gone = reduce(DataFrame.unionByName, [load(f, "gone", "path string").withColumn("at", F.lit(k)) for k, f in enumerate(folders) if k])
        gone = gone.groupBy(F.col("path").alias("gone_path")).agg(F.max("at").alias("gone_at"))
        out = {}
        for name, schema in TABLES.items():
            key = "source_path" if name == "links" else "path"
            rows = reduce(DataFrame.unionByName, [load(f, name, schema).withColumn("at", F.lit(k)) for k, f in enumerate(folders)])
            out[name] = rows.join(gone, (F.col(key) == F.col("gone_path")) & (F.col("gone_at") > F.col("at")), "left_anti").drop("at")
        return out

    def _save(self, tables: dict[str, DataFrame]) -> str:
        folder = uuid.uuid4().hex
        for name, schema in TABLES.items():
            columns = [c.split()[0] for c in schema.split(", ")]
            writer = tables[name].select(*columns).write
            (writer.partitionBy("layer") if name == "chunks" else writer).parquet(f"{self.path}/{folder}/{name}")
        return folder

    def write(self, tables: dict[str, DataFrame]) -> str:
        """A new base."""
        return self.point_to([self._save(tables)])

    def change(self, gone: DataFrame, new: dict[str, DataFrame] | None = None, dim: int | None = None) -> str:
        """Takes away what the paths in `gone` have, and adds new tables; vectors of unchanged chunks stay where dim is given."""
        folders = self.folders()
        if not folders or len(folders) > MOST_CHANGES:
            folders = [self._save(self.read())]
        if new is None:
            new = {name: self.spark.createDataFrame([], schema) for name, schema in TABLES.items()}
        if dim is not None:
            new = {**new, "chunks": reuse_vectors(new["chunks"], self.read()["chunks"], dim)}
        folder = self._save(new)
        gone.select("path").distinct().write.parquet(f"{self.path}/{folder}/gone")
        return self.point_to([*folders, folder])

    def compact(self) -> str:
        """The same rows as one base."""
        return self.write(self.read())

    def upsert(self, files: DataFrame, dim: int | None = None) -> str:
        return self.change(files, build(files), dim)

    def delete(self, paths: DataFrame) -> str:
        return self.change(paths)

    def clear(self) -> str:
        return self.write({name: self.spark.createDataFrame([], schema) for name, schema in TABLES.items()})


def catalog_upsert(catalog: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """A keyed table with rows added, or in the place of those of equal key."""
    return catalog.join(rows.select(*key).distinct(), list(key), "left_anti").unionByName(rows)


def catalog_delete(catalog: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    return catalog.join(rows.select(*key).distinct(), list(key), "left_anti")
