"""Results that later steps read more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, local mode gets a temporary one; a cluster gets an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quillspark-")
    return named.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df, computed once: written to the shared folder that spark.checkpoint.dir names, where lost executors don't matter. Without one (in tests)
    it is kept by the executors."""
    sc = df.sparkSession.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        return df.persist()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)
