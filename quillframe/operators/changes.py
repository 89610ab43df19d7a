"""Edits of cells as a log: ordered deltas, merged on read, the last writer winning.

A cell is named by entry, saveframe, kind, loop, row and tag. A commit is a folder of its own with the next number; it counts once Spark's
writer has marked it whole (``_SUCCESS``), so a commit that fails, or whose check fails before it is written, leaves the
table as it was. Reading reduces the deltas to the last one a cell and passes once over the base, however many commits
there are; ``compact`` writes that as a new base.

One writer at a time is assumed: two that commit at once would take one number, and the second fails, as its folder is there.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators.frames import raise_where

KEY = ["entry_id", "sf_ord", "kind", "loop_ord", "row_ord", "tag"]


class CellLog:
    """A table of cells under a path: ``base-N`` holds all cells after commit N, ``delta-N`` what commit N changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, cells: DataFrame, path: str) -> CellLog:
        """A log that begins with some cells."""
        log = cls(cells.sparkSession, path)
        cells.write.parquet(f"{log.path}/base-000000")
        return log

    def _whole(self) -> dict[str, list[int]]:
        """Numbers of the bases and deltas that were written whole."""
        jvm, found = self.spark._jvm, {"base": [], "delta": []}
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in store.listStatus(root):
            name = status.getPath().getName()
            if (m := re.fullmatch(r"(base|delta)-(\d+)", name)) and store.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")):
                found[m[1]].append(int(m[2]))
        return {k: sorted(v) for k, v in found.items()}

    @property
    def version(self) -> int:
        """The number of the last commit."""
        whole = self._whole()
        return max(whole["base"] + whole["delta"])

    def read(self, version: int | None = None) -> DataFrame:
        """The cells after a commit, the last by default."""
        whole = self._whole()
        version = max(whole["base"] + whole["delta"]) if version is None else version
        first = max(n for n in whole["base"] if n <= version)
        base = self.spark.read.parquet(f"{self.path}/base-{first:06d}")
        numbers = [n for n in whole["delta"] if first < n <= version]
        if not numbers:
            return base
        deltas = None
        for n in numbers:
            one = self.spark.read.parquet(f"{self.path}/delta-{n:06d}").withColumn("_version", F.lit(n))
            deltas = one if deltas is None else deltas.unionByName(one)
        # map-side: a struct's maximum, so that a cell edited in every commit is one row a task
        columns = [c for c in base.columns if c not in KEY]
        last = deltas.groupBy(*KEY).agg(F.max_by(F.struct("_gone", *columns), "_version").alias("_last"))
        kept = base.join(last, KEY, "left_anti").select(base.columns)
        return kept.unionByName(last.where("not _last._gone").select(*KEY, *[F.col(f"_last.{c}").alias(c) for c in columns]).select(base.columns))

    def commit(self, changed: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Set the cells ``changed`` (all columns) and take away ``removed`` (the key); returns the commit's number.

        A cell twice in one commit, one removed that is not there, or a null in a name is an error, and nothing is written.
        """
        now = self.read()
        parts = []
        if changed is not None:
            parts.append(changed.select(now.columns).withColumn("_gone", F.lit(False)))
        if removed is not None:
            others = [F.lit(None).cast(f.dataType).alias(f.name) for f in now.schema.fields if f.name not in KEY]
            parts.append(removed.select(*KEY, *others).select(now.columns).withColumn("_gone", F.lit(True)))
            raise_where(now, removed.join(now, KEY, "left_anti").select(F.concat_ws(" ", *KEY).alias("k")), "there is no cell ")
        if not parts:
            raise ValueError("a commit changes or removes something")
        delta = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        unnamed = F.lit(False)
        for k in KEY:
            unnamed = unnamed | F.col(k).isNull()
        raise_where(now, delta.where(unnamed).select(F.concat(F.lit("a null in "), F.concat_ws(" ", *KEY)).alias("k")), "a cell's name holds ")
        raise_where(now, delta.groupBy(*KEY).count().where("count > 1").select(F.concat_ws(" ", *KEY).alias("k")), "a commit changes a cell twice: ")
        number = self.version + 1
        delta.write.parquet(f"{self.path}/delta-{number:06d}")
        return number

    def compact(self) -> int:
        """Write the cells as they are as a new base."""
        number = self.version
        if number not in self._whole()["base"]:
            self.read().write.parquet(f"{self.path}/base-{number:06d}")
        return number
