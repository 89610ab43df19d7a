"""Rendering of cell tables as tag/loop text, JSON and CSV, with ordered aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.names import is_null
from quillframe.functions.quoting import quote_value


def in_order(order: str, text: str) -> Column:
    """Aggregate: the texts of a group joined by ascending order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "")


def format_loops(cells: DataFrame, loops: DataFrame, keys: list[str], skip_empty_loops: bool = False, skip_empty_tags: bool = False) -> DataFrame:
    """(keys, text): each loop as text. ``keys`` name a loop in both tables; ``loops`` has category and tags."""
    column = Window.partitionBy(*keys, "col_ord")
    cells = cells.select(*keys, "row_ord", "col_ord", "value")
    if skip_empty_tags:
        cells = cells.withColumn("held", F.max((~is_null(F.col("value"))).cast("int")).over(column)).where("held = 1").drop("held")
    cells = cells.withColumn("quoted", quote_value(F.col("value")))
    multi = F.contains("quoted", F.lit("\n"))
    width = F.greatest(F.lit(4), F.coalesce(F.max(F.when(~multi, F.length("quoted") + 3)).over(column), F.lit(4)))
    shown = F.when(multi, F.concat(F.lit("\n;\n"), "quoted", F.lit(";\n"))).otherwise(F.col("quoted"))
    cells = cells.withColumn("width", width).withColumn("shown", shown)
    cells = cells.withColumn("shown", F.when(F.length("shown") >= F.col("width"), F.col("shown")).otherwise(F.rpad("shown", F.col("width"), F.lit(" "))))
    rows = cells.groupBy(*keys, "row_ord").agg(in_order("col_ord", "shown").alias("line"), F.collect_set("col_ord").alias("shown_cols"))
    rows = rows.withColumn("line", F.concat(F.lit("     "), "line", F.lit(" \n")))
    bodies = rows.groupBy(*keys).agg(in_order("row_ord", "line").alias("body"), F.first("shown_cols").alias("shown_cols"))
    whole = loops.select(*keys, "category", "tags").join(bodies, keys, "left")
    tags = F.col("tags") if not skip_empty_tags else F.filter("tags", lambda t, i: F.coalesce(F.array_contains("shown_cols", i), F.lit(True)))
    names = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("      "), "category", F.lit("."), t, F.lit("\n"))), "")
    text = F.concat(F.lit("\n   loop_\n"), names, F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n   stop_\n"))
    text = F.when(F.size("tags") == 0, F.lit("\n   loop_\n\n   stop_\n")).otherwise(text)
    if skip_empty_loops:
        text = F.when(F.col("body").isNull(), F.lit("")).otherwise(text)
    return whole.select(*keys, text.alias("text"))


def format_frames(frames: DataFrame, cells: DataFrame, loop_texts: DataFrame, comments: DataFrame | None = None, skip_empty_tags: bool = False) -> DataFrame:
    """(entry_id, sf_ord, text): each saveframe with its tags, loops (entry_id, sf_ord, loop_ord, text) and, first of its category, its banner."""
    keys = ["entry_id", "sf_ord"]
    tags = cells.where("kind = 'tag'")
    if skip_empty_tags:
        tags = tags.where(~is_null(F.col("value")))
    full = F.concat("category", F.lit("."), "tag")
    tags = tags.withColumn("full", full).withColumn("quoted", quote_value(F.col("value"))).withColumn("width", F.max(F.length("full")).over(Window.partitionBy(*keys)))
    padded = F.concat(F.lit("   "), F.rpad("full", F.col("width"), F.lit(" ")))
    line = F.when(F.contains("quoted", F.lit("\n")), F.concat(padded, F.lit("\n;\n"), "quoted", F.lit(";\n"))).otherwise(F.concat(padded, F.lit("  "), "quoted", F.lit("\n")))
    tag_texts = tags.withColumn("line", line).groupBy(*keys).agg(in_order("col_ord", "line").alias("tag_text"))
    loop_bodies = loop_texts.groupBy(*keys).agg(in_order("loop_ord", "text").alias("loop_text"))
    whole = frames.join(tag_texts, keys, "left").join(loop_bodies, keys, "left")
    banner = F.lit("")
    if comments is not None:
        nth = F.row_number().over(Window.partitionBy("entry_id", "sf_category").orderBy("sf_ord"))
        whole = whole.withColumn("nth", nth).join(F.broadcast(comments.select(F.col("category").alias("sf_category"), "comment")), "sf_category", "left")
        banner = F.when(F.col("nth") == 1, F.coalesce("comment", F.lit(""))).otherwise(F.lit(""))
    text = F.concat(banner, F.lit("save_"), "sf_name", F.lit("\n"), F.coalesce("tag_text", F.lit("")), F.coalesce("loop_text", F.lit("")), F.lit("\nsave_\n"))
    return whole.select(*keys, text.alias("text"))


def format_entries(frame_texts: DataFrame) -> DataFrame:
    """(entry_id, text): whole entries."""
    framed = frame_texts.withColumn("text", F.concat("text", F.lit("\n")))
    return framed.groupBy("entry_id").agg(in_order("sf_ord", "text").alias("body")).select("entry_id", F.concat(F.lit("data_"), "entry_id", F.lit("\n\n"), F.substring(F.col("body"), F.lit(1), F.length("body") - 1)).alias("text"))


def loop_json(cells: DataFrame, loops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): each loop with its category, tags and rows; nulls are kept."""
    rows = cells.groupBy(*keys, "row_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_ord", "value"))), lambda x: x["value"]).alias("row"))
    data = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "row"))), lambda x: x["row"]).alias("data"))
    whole = loops.join(data, keys, "left").withColumn("data", F.coalesce("data", F.array().cast("array<array<string>>")))
    return whole.select(*keys, F.to_json(F.struct("category", "tags", "data"), {"ignoreNullFields": "false"}).alias("json"))


def entry_json(frames: DataFrame, cells: DataFrame, loops: DataFrame) -> DataFrame:
    """(entry_id, json): whole entries, in the shape that ``from_json`` reads."""
    keys, loop_keys = ["entry_id", "sf_ord"], ["entry_id", "sf_ord", "loop_ord"]
    rows = cells.where("kind = 'loop'").groupBy(*loop_keys, "row_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_ord", "value"))), lambda x: x["value"]).alias("row"))
    data = rows.groupBy(*loop_keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "row"))), lambda x: x["row"]).alias("data"))
    tables = loops.join(data, loop_keys, "left").withColumn("data", F.coalesce("data", F.array().cast("array<array<string>>")))
    nested = tables.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("loop_ord", F.struct("category", "tags", "data").alias("loop")))), lambda x: x["loop"]).alias("loops"))
    tags = cells.where("kind = 'tag'").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("col_ord", F.array("tag", "value").alias("pair")))), lambda x: x["pair"]).alias("tags"))
    framed = frames.join(tags, keys, "left").join(nested, keys, "left").withColumn("loops", F.coalesce("loops", F.array().cast("array<struct<category:string,tags:array<string>,data:array<array<string>>>>")))
    framed = framed.select(*keys, F.struct(F.col("sf_name").alias("name"), F.col("sf_category").alias("category"), "tag_prefix", "tags", "loops").alias("frame"))
    entries = framed.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sf_ord", "frame"))), lambda x: x["frame"]).alias("saveframes"))
    return entries.select("entry_id", F.to_json(F.struct("entry_id", "saveframes"), {"ignoreNullFields": "false"}).alias("json"))


def csv_line(columns: list[Column]) -> Column:
    """A CSV line of some values: quoted only where needed, null as nothing."""
    shown = [F.when(c.rlike("[,\"\\r\\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit(""))) for c in columns]
    return F.concat_ws(",", *shown)
