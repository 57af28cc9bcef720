"""The corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and reads it as the
next stage's docs. All stages but the last return the columns of documents. Nulls, empty texts, ties, repeated rows and extra
columns have the results that the operators' docstrings define; an empty table stays empty.

The stages share long-lived Python workers, of which an executor holds several beside its heap. So a stage sets Arrow batches to 1,000 rows in
a session that has Spark's own 10,000 (texts of some KB each then travel in batches of some MB); run() puts that back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontamination, language_id, near_copies, packing, suffix_dedup
from quillspark.llm.common import delete, scratch_dir, table


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH_ROWS) == "10000":
            spark.conf.set(BATCH_ROWS, "1000")
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def spoken(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; the model learns from labelled rows that aren't held out."""
    return language_id.accepted(docs, language_id.learn(docs))


@small_batches
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of a Jaccard similarity of 0.8 or more over five-word shingles join, that with the least id; candidates
    come from the SimHash operator and, for what differs in more bits than it reaches, from MinHash bands."""
    return near_copies.one_of_each(docs)


@small_batches
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 50-byte strings that a document with a smaller id has; n_chars follows."""
    return suffix_dedup.without_repeats(docs)


@small_batches
def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


@small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", spoken), ("simhash", one_of_near_copies), ("suffix_dedup", without_repeats), ("decontamination", without_leaks), ("packing", packed)]

#: SQL can't express a tokenizer or a trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and read again; the folder of a stage goes when the next one is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{scratch_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}", None
    rows = spark.conf.get(BATCH_ROWS)
    try:
        for k, (name, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(out := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(out)
            if before:
                delete(spark, before)
            before = out
    finally:
        spark.conf.set(BATCH_ROWS, rows)
    return docs
