"""A clustered store of cells: lower-case keys, sorted by them, so that look-ups by tag read few row groups.

Names are compared in any case, and ``lower(category)`` is no predicate that a scan can use. The store has the lower-case names as
columns, is dealt by ranges and sorted by category, tag and value, and has Bloom filters on tags and values. Readers that
filter by ``category_lc``, ``tag_lc`` or ``value`` skip row groups by their statistics and filters; the operators of ``entries`` do
so by themselves when these columns are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names beside their lower-case forms.
LOWERED = {"category": "category_lc", "tag": "tag_lc"}
ORDER = ["category_lc", "tag_lc", "value"]


def write_cells(cells: DataFrame, path: str, mode: str = "errorifexists", row_group: int = 64 << 20, distinct_values: int = 1_000_000) -> None:
    """Write cells in clusters; ``distinct_values`` sizes a row group's Bloom filter of values.

    The value is part of the ranges' order, so a tag that most cells have spans many tasks and files.
    """
    keyed = cells.withColumns({low: F.lower(name) for name, low in LOWERED.items()})
    options = {
        "parquet.block.size": row_group, "parquet.bloom.filter.enabled#tag_lc": "true", "parquet.bloom.filter.expected.ndv#tag_lc": 10_000,
        "parquet.bloom.filter.enabled#value": "true", "parquet.bloom.filter.expected.ndv#value": distinct_values,
    }
    keyed.repartitionByRange(*ORDER, "entry_id", "sf_ord", "loop_ord", "row_ord").sortWithinPartitions(*ORDER).write.mode(mode).options(**options).parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The stored cells, with their lower-case names."""
    return spark.read.parquet(path)
