"""Ranks within groups of any size.

A window puts a whole group into one task; a group here may be most of the table (one entry, one loop).
Rows are dealt by ranges of (group, order), so a large group spans ranges. A row's rank is its place among its group's rows of
its range, plus the group's rows in earlier ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.lineage import cut


def ranked_within(rows: DataFrame, groups: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Rows with ``name``, their number from 1 in the total order of their group; null is a group like any other.

    The dealt rows are checkpointed at once, since ranges rest on a sample. Of the sums of earlier ranges only those of groups that
    span ranges are broadcast: fewer than there are ranges, as each range begins within one group at most.
    """
    keys = [F.col(g) for g in groups]
    dealt = cut(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    here = Window.partitionBy("_range", *groups).orderBy(*order)
    sizes = dealt.groupBy("_range", *groups).count()
    past = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.sum("count").over(past)).where("_before is not null")
    before = before.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_before")
    placed = dealt.withColumn(name, F.row_number().over(here).cast("long"))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = placed.join(F.broadcast(before), same, "left")
    return joined.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).select(*rows.columns, name)
