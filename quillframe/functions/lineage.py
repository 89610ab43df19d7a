"""Cutting long lineages, so that plans stay small and lost executors cost one stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder's name in the store that every node shares, for tables and files of this run."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a checkpoint in the store that every node shares (``spark.checkpoint.dir``).

    Where a local session names no such store, as in tests, a temporary folder takes its place. On a cluster that is an
    error: other machines would not see the folder.
    """
    _shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows as ``cut`` gives, kept by column: of a wide table that is read for a few columns at a time, only these are read."""
    path = scratch_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
