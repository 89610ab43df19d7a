"""Listings and small reports over cell tables: outlines, tables of tags, and tables of one category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.operators.frames import raise_where


def outline(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(depth, parent, nth, label): parents (parent, label) at depth 0, and their children (parent, ord, label) numbered below them."""
    top = parents.select(F.lit(0).alias("depth"), "parent", F.lit(0).cast("long").alias("nth"), "label")
    nth = F.row_number().over(Window.partitionBy("parent").orderBy("ord")).cast("long")
    return top.unionByName(children.select(F.lit(1).alias("depth"), "parent", nth.alias("nth"), "label"))


def tree_lines(frames: DataFrame, loops: DataFrame) -> DataFrame:
    """(entry_id, sf_ord, loop_ord, line): an indented outline of entries, their saveframes and loops."""
    nth = F.row_number().over(Window.partitionBy("entry_id").orderBy("sf_ord")) - 1
    entry = frames.select("entry_id").distinct().select("entry_id", F.lit(-1).cast("long").alias("sf_ord"), F.lit(-1).cast("long").alias("loop_ord"), F.concat(F.lit("entry "), "entry_id").alias("line"))
    frame = frames.select("entry_id", F.col("sf_ord").cast("long").alias("sf_ord"), F.lit(-1).cast("long").alias("loop_ord"), F.concat(F.lit("\t["), nth.cast("string"), F.lit("] saveframe "), "sf_name").alias("line"))
    at = F.row_number().over(Window.partitionBy("entry_id", "sf_ord").orderBy("loop_ord")) - 1
    loop = loops.select("entry_id", F.col("sf_ord").cast("long").alias("sf_ord"), F.col("loop_ord").cast("long").alias("loop_ord"), F.concat(F.lit("\t\t["), at.cast("string"), F.lit("] loop "), "category").alias("line"))
    return entry.unionByName(frame).unionByName(loop)


def tag_outline(frames: DataFrame, cells: DataFrame, loops: DataFrame) -> DataFrame:
    """(entry_id, sf_ord, loop_ord, col_ord, line): entries, their saveframes, these' tags, their loops and the loops' tags.

    Sorted by the first four columns it reads as an outline; -1 stands before all that is numbered.
    """
    none = F.lit(-1).cast("long")
    line = lambda *parts: F.concat(*[F.lit(x) if x.startswith((" ", ":", ".", "E")) else F.col(x) for x in parts]).alias("line")
    entry = frames.select("entry_id").distinct().select("entry_id", none.alias("sf_ord"), none.alias("loop_ord"), none.alias("col_ord"), line("Entry ", "entry_id"))
    frame = frames.select("entry_id", F.col("sf_ord").cast("long"), none.alias("loop_ord"), none.alias("col_ord"), F.concat(F.lit("  Saveframe "), "sf_name", F.lit(":"), F.coalesce("sf_category", F.lit("None"))).alias("line"))
    tag = cells.where("kind = 'tag'").select("entry_id", F.col("sf_ord").cast("long"), none.alias("loop_ord"), F.col("col_ord").cast("long"), line("    ", "category", ".", "tag"))
    loop = loops.select("entry_id", F.col("sf_ord").cast("long"), F.col("loop_ord").cast("long"), none.alias("col_ord"), line("    Loop ", "category"))
    column = loops.select("entry_id", F.col("sf_ord").cast("long"), F.col("loop_ord").cast("long"), "category", F.posexplode("tags").alias("col_ord", "tag"))
    column = column.select("entry_id", "sf_ord", "loop_ord", F.col("col_ord").cast("long"), line("      ", "category", ".", "tag"))
    return entry.unionByName(frame).unionByName(tag).unionByName(loop).unionByName(column)


def value_lines(cells: DataFrame) -> DataFrame:
    """(entry_id, sf_ord, col_ord, line): each saveframe's own tags as ``tag: value``, newlines shown as two characters."""
    shown = F.replace(F.coalesce("value", F.lit("None")), F.lit("\n"), F.lit("\\n"))
    return cells.where("kind = 'tag'").select("entry_id", "sf_ord", "col_ord", F.concat("category", F.lit("."), "tag", F.lit(": "), shown).alias("line"))


def frame_lines(frames: DataFrame, detail: Column) -> DataFrame:
    """(line): each saveframe's name and a detail."""
    return frames.select(F.concat("sf_name", F.lit(": "), detail).alias("line"))


def side_by_side(columns: Sequence[DataFrame], separator: str = "\t") -> DataFrame:
    """(n, line): columns of (n, value) beside each other; where one ends, it stays empty."""
    whole = columns[0].withColumnRenamed("value", "v0")
    for i, column in enumerate(columns[1:], 1):
        whole = whole.join(column.withColumnRenamed("value", f"v{i}"), "n", "full")
    return whole.select("n", F.concat_ws(separator, *[F.coalesce(f"v{i}", F.lit("")) for i in range(len(columns))]).alias("line"))


def only_frame(frames: DataFrame, category: str) -> DataFrame:
    """Each entry's one saveframe of a category; several are an error."""
    found = frames.where(F.col("sf_category") == category)
    several = found.groupBy("entry_id").count().where("count > 1").select("entry_id")
    return raise_where(found, several, f"several saveframes of {category} in ")


def first_of_category(frames: DataFrame, category: str = "sf_category", order: str = "sf_ord", keys: Sequence[str] = ("entry_id",)) -> DataFrame:
    """Frames with ``first_in_category``: whether they come first among those of their category."""
    return frames.withColumn("first_in_category", F.row_number().over(Window.partitionBy(*keys, category).orderBy(order)) == 1)


def numbered_lines(lines: DataFrame, order: Sequence[str], none: str) -> DataFrame:
    """(n, line) of (order, line), numbered from 1 without bringing all to one task; one line when there is none."""
    from quillframe.operators.table import numbered

    found = numbered(lines.select(*order, "line"), order, "n", 1).select("n", "line")
    empty = lines.agg(F.count("*").alias("k")).where("k = 0").select(F.lit(0).cast("long").alias("n"), F.lit(none).alias("line"))
    return found.unionByName(empty)
