"""Files as they arrive: every micro-batch is parsed whole; of each entry the latest file is what the store holds.

A file's version is (its time of change, its name), so neither the order of arrival nor a replay matters: a late older file
changes nothing, and a batch that is repeated replaces what it wrote. A file of ``data_name`` alone, without saveframes, takes its
entry away. What the store holds is decided on reading, from one small row a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillframe.sources.star import StarTables, parse

TABLES = ("entries", "saveframes", "loops", "cells", "errors")


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Parse all files of a folder that were not parsed before, into a folder of ``out`` for each of the tables."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).load(path)
    # time and name go with the file's name through the parser
    named = F.concat_ws("\t", F.date_format("_metadata.file_modification_time", "yyyyMMddHHmmssSSSSSS"), "_metadata.file_path")

    def write(batch: DataFrame, number: int) -> None:
        found = parse(batch)
        for name in TABLES:
            versioned(getattr(found, name)).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return files.select(named.alias("file"), F.col("value").alias("text")).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versioned(rows: DataFrame) -> DataFrame:
    """Rows of files named as ``ingest`` does, with the name alone in ``file``, and ``version``."""
    return rows.withColumn("version", F.col("file")).withColumn("file", F.substring_index("file", "\t", -1))


def latest(entries: DataFrame) -> DataFrame:
    """(entry_id, version) of the entries that a store holds, from (file, entry_id, n_frames, version) of all files parsed.

    Counts and versions combine in tasks, so an entry that is sent again and again costs a row a task.
    """
    last = entries.where("entry_id is not null").groupBy("entry_id").agg(F.max(F.struct("version", "n_frames")).alias("last"))
    return last.where("last.n_frames > 0").select("entry_id", "last.version")


def read_store(spark: SparkSession, out: str) -> StarTables:
    """The tables of the latest file of each entry; errors are those of all files."""
    read = {name: spark.read.parquet(f"{out}/{name}").drop("batch") for name in TABLES}
    now = latest(read["entries"])
    # a replayed file gives its rows again under the same version; batches are distinct otherwise
    held = {name: read[name].join(now, ["entry_id", "version"], "left_semi").drop("version") for name in TABLES[:4]}
    return StarTables(*held.values(), read["errors"].drop("version"))
