"""Loops and saveframes as CSV, in both directions, and the banners of categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.errors import InvalidStateError
from quillframe.functions.names import is_null
from quillframe.sources.writer import csv_line

_OPTIONS = {"escape": '"', "multiLine": "true"}


def loop_from_csv(spark: SparkSession, path: str) -> tuple[str | None, DataFrame]:
    """(category, rows) of CSV files with a header of tags, qualified or not; all values are text, in one shared order of columns.

    A row of more or fewer values than the header fails the job that reads it.
    """
    read = spark.read.options(header=True, enforceSchema=False, mode="FAILFAST", **_OPTIONS).csv(path)
    named = [c for c in read.columns if "." in c]
    category = named[0].partition(".")[0] if named else None
    if any(c.partition(".")[0].lower() != category.lower() for c in named):
        raise ValueError("the header names tags of several categories")
    return category, read.toDF(*[c.partition(".")[2] or c for c in read.columns])


def loop_rows_from_csv(lines: DataFrame, line_col: str, tags: Sequence[str]) -> DataFrame:
    """CSV lines of a column as rows of the given tags, all text."""
    read = lines.select(F.from_csv(line_col, ", ".join(f"`{t}` string" for t in tags), {"escape": '"'}).alias("r"))
    return read.select("r.*")


def frame_from_csv(spark: SparkSession, path: str) -> tuple[str | None, DataFrame]:
    """(category, tags) of a CSV file with a header of tags and one row: (tag, value, col_ord), never converted.

    No row, or several, are an error, as is a row of another length than the header.
    """
    category, read = loop_from_csv(spark, path)
    n = len(read.select(*[F.col(f"`{c}`") for c in read.columns]).take(2))
    if n != 1:
        raise InvalidStateError("a saveframe has one row of values, and no more")
    pairs = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(f"`{t}`").alias("value")) for t in read.columns])
    return category, read.select(F.posexplode(pairs).alias("col_ord", "pair")).select("pair.tag", "pair.value", "col_ord")


def loop_to_csv(rows: DataFrame, tags: Sequence[str], category: str, order: str, header: bool = True, show_category: bool = True) -> DataFrame:
    """(n, line): a loop as CSV lines, the header before them with n = -1; ``order`` numbers the rows."""
    names = [f"{category}.{t}" if show_category else t for t in tags]
    lines = rows.select(F.col(order).cast("long").alias("n"), csv_line([F.col(f"`{t}`").cast("string") for t in tags]).alias("line"))
    if not header:
        return lines
    return rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("n"), csv_line([F.lit(x) for x in names]).alias("line")).unionByName(lines)


def frames_to_csv(cells: DataFrame, show_category: bool = True) -> DataFrame:
    """(entry_id, sf_ord, header, line): each saveframe's tags as a CSV header and one line."""
    name = F.concat("category", F.lit("."), "tag") if show_category else F.col("tag")
    quoted = cells.where("kind = 'tag'").select("entry_id", "sf_ord", F.struct("col_ord", csv_line([name]).alias("h"), csv_line([F.col("value")]).alias("v")).alias("x"))
    gathered = quoted.groupBy("entry_id", "sf_ord").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return gathered.select("entry_id", "sf_ord", F.array_join("xs.h", ",").alias("header"), F.array_join("xs.v", ",").alias("line"))


def banners(cells: DataFrame, category_tag: str = "category", comment_tag: str = "comment") -> DataFrame:
    """(category, comment): the banners held in a parsed file's loop; null ones go, the others end with one blank line."""
    loop = cells.where("kind = 'loop'").groupBy("entry_id", "sf_ord", "loop_ord", "row_ord")
    pick = lambda t: F.max(F.when(F.lower("tag") == t.lower(), F.col("value")))
    rows = loop.agg(pick(category_tag).alias("category"), pick(comment_tag).alias("comment")).where(~is_null(F.col("comment")))
    return rows.select("category", F.concat(F.regexp_replace("comment", r"\s+$", ""), F.lit("\n\n")).alias("comment"))
