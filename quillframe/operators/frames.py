"""Upkeep of saveframes: tables of frames (entry_id, sf_ord, sf_name, sf_category, tag_prefix) and of their tags' cells.

``cells`` has kind, category, tag, value and col_ord beside the frame's keys. Names, categories and the tags
``Sf_framecode`` and ``Sf_category`` are kept the same, whichever of them is set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.errors import InvalidStateError, MissingError
from quillframe.functions.names import NULL_TEXTS, format_category, format_tag, format_tag_lower

KEYS = ["entry_id", "sf_ord"]


def checked_name(name: str | None, what: str = "name") -> str:
    """A name that is no null-equivalent and holds no white space; else an error."""
    if name is None or name in NULL_TEXTS or any(c.isspace() for c in name):
        raise ValueError(f"{name!r} is no {what}")
    return name


def raise_where(rows: DataFrame, bad: DataFrame, message: str, error: type[InvalidStateError] = InvalidStateError) -> DataFrame:
    """The rows, or an error if ``bad`` (one text column) has any row. The check runs at once, and brings one row to the driver."""
    first = bad.agg(F.min(bad.columns[0])).first()[0]
    if first is not None:
        raise error(f"{message}{first}")
    return rows


def present(rows: DataFrame, message: str) -> DataFrame:
    """The rows, or a ``MissingError`` if there is none."""
    if rows.isEmpty():
        raise MissingError(message)
    return rows


def frame_by_name(frames: DataFrame, name: str) -> DataFrame:
    """The saveframes of a name, the first in each entry; a ``MissingError`` if there is none."""
    found = present(frames.where(F.col("sf_name") == name), f"there is no saveframe {name}")
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("entry_id").orderBy("sf_ord"))).where("_n = 1").drop("_n")


def loop_of_frame(loops: DataFrame, item: int | str) -> DataFrame:
    """In each saveframe its loop at a place, counted from 0 (below 0: from the end), or of a category in any case; a ``MissingError`` if there is none."""
    if isinstance(item, str):
        name = item if item.startswith("_") else f"_{item}"
        return present(loops.where(F.lower("category") == name.lower()), f"there is no loop {item}")
    order = Window.partitionBy(*KEYS).orderBy("loop_ord" if item >= 0 else F.desc("loop_ord"))
    nth = item if item >= 0 else -item - 1
    placed = loops.withColumn("_n", F.row_number().over(order) - 1).where(F.col("_n") == nth).drop("_n")
    return present(placed, f"there is no loop at {item}")


def frame_item(cells: DataFrame, item: str) -> DataFrame:
    """(entry_id, sf_ord, row_ord, value) of a tag as ``frame_tag`` finds it; a ``MissingError`` if no saveframe has it."""
    return present(frame_tag(cells, item), f"there is no tag {item}")


def frame_by_place(frames: DataFrame, nth: int) -> DataFrame:
    """The saveframe at each entry's position ``nth``, counted from 0."""
    place = F.row_number().over(Window.partitionBy("entry_id").orderBy("sf_ord")) - 1
    return frames.withColumn("_n", place).where(F.col("_n") == nth).drop("_n")


def frame_tag(cells: DataFrame, tag: str) -> DataFrame:
    """(entry_id, sf_ord, value) of a tag in each saveframe: a loop of the frame's category decides before its own tags."""
    own = cells.where((F.col("kind") == "tag") & (format_tag_lower(F.col("tag")) == format_tag_lower(F.lit(tag))))
    prefix = cells.where("kind = 'tag'").select(*KEYS, F.lower("category").alias("_prefix")).distinct()
    loops = cells.where((F.col("kind") == "loop") & (format_tag_lower(F.col("tag")) == format_tag_lower(F.lit(tag)))).join(prefix, KEYS).where(F.lower("category") == F.col("_prefix"))
    held = loops.select(*KEYS).distinct()
    return loops.select(*KEYS, "row_ord", "value").unionByName(own.join(held, KEYS, "left_anti").select(*KEYS, "row_ord", "value"))


def first_value(cells: DataFrame, tag: str, order: Sequence[str]) -> DataFrame:
    """(entry_id, sf_ord, value): each saveframe's first value of a tag in an order."""
    hits = cells.where(format_tag_lower(F.col("tag")) == format_tag_lower(F.lit(tag)))
    return hits.groupBy(*KEYS).agg(F.min_by("value", F.struct(*order)).alias("value"))


def add_tags(cells: DataFrame, frames: DataFrame, tags: DataFrame, update: bool = False) -> tuple[DataFrame, DataFrame]:
    """The (cells, frames) after adding (entry_id, sf_ord, tag, value); a missing value is a dot.

    A tag that a frame has is an error unless ``update`` is set, when its value is replaced. A qualified tag must be
    of the frame's category; ``Sf_framecode`` must be the frame's name; ``Sf_category`` sets the frame's category.
    """
    held = cells.where("kind = 'tag'")
    asked = tags.join(frames.select(*KEYS, "sf_name", "sf_category", "tag_prefix"), KEYS).withColumn("value", F.coalesce("value", F.lit(".")))
    asked = asked.withColumn("low", format_tag_lower(F.col("tag"))).withColumn("short", format_tag(F.col("tag")))
    wrong = (
        F.when((F.instr("tag", ".") > 1) & (F.lower(format_category(F.col("tag"))) != F.lower("tag_prefix")), F.concat(F.col("tag"), F.lit(" is of another category")))
        .when((F.col("low") == "sf_framecode") & (F.col("value") != F.col("sf_name")), F.concat(F.lit("Sf_framecode must be the saveframe's name: "), "sf_name"))
        .when(F.col("short").isin(*NULL_TEXTS) | F.col("short").rlike(r"[\s.]"), F.concat(F.lit("no name for a tag: "), "tag"))
    )
    bad = asked.select(wrong.alias("message")).where("message is not null")
    had = held.select(*KEYS, format_tag_lower(F.col("tag")).alias("low"), F.col("col_ord").alias("_at"))
    if not update:
        bad = bad.unionByName(asked.join(had, [*KEYS, "low"]).select(F.concat(F.lit("there is a tag "), "tag").alias("message")))
    asked = raise_where(asked, bad, "")
    last = held.groupBy(*KEYS).agg(F.max("col_ord").alias("_last"))
    placed = asked.join(had, [*KEYS, "low"], "left").join(last, KEYS, "left")
    nth = F.row_number().over(Window.partitionBy(*KEYS, F.col("_at").isNull()).orderBy("low"))
    made = placed.withColumn("_nth", nth).select(
        *KEYS, "sf_name", F.when(F.col("low") == "sf_category", F.col("value")).otherwise(F.col("sf_category")).alias("sf_category"), F.lit("tag").alias("kind"), F.lit(0).cast("long").alias("loop_ord"), F.col("tag_prefix").alias("category"),
        F.lit(0).cast("long").alias("row_ord"), F.coalesce("_at", F.coalesce("_last", F.lit(-1)) + F.col("_nth")).cast("int").alias("col_ord"), F.col("short").alias("tag"), "value",
    )
    names = [c for c in made.columns if c in cells.columns]
    others = cells.select(*names).withColumn("low", format_tag_lower(F.col("tag"))).withColumn("own", F.col("kind") == "tag")
    gone = asked.select(*KEYS, "low").distinct().withColumn("own", F.lit(True))
    kept = others.join(gone, [*KEYS, "low", "own"], "left_anti").select(*names)
    new = asked.where("low = 'sf_category'").select(*KEYS, F.col("value").alias("_category"))
    moved = frames.join(new, KEYS, "left").withColumn("sf_category", F.coalesce("_category", "sf_category")).select(*frames.columns)
    return kept.unionByName(made.select(*names)), moved


def set_frame(cells: DataFrame, frames: DataFrame, name: str, new_name: str | None = None, category: str | None = None, prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The (cells, frames) with the saveframes of a name given another name, category or tag prefix, and the tags that tell them."""
    here, low, own = F.col("sf_name") == name, format_tag_lower(F.col("tag")), F.col("kind") == "tag"
    value, columns = F.col("value"), {}
    if new_name is not None:
        columns["sf_name"] = F.when(here, F.lit(checked_name(new_name))).otherwise(F.col("sf_name"))
        value = F.when(here & own & (low == "sf_framecode"), F.lit(new_name)).otherwise(value)
    if category is not None:
        columns["sf_category"] = F.when(here, F.lit(checked_name(category, "category"))).otherwise(F.col("sf_category"))
        value = F.when(here & own & (low == "sf_category"), F.lit(category)).otherwise(value)
    found = cells.withColumn("value", value)
    if prefix is not None:
        made = format_category(F.lit(checked_name(prefix, "category")))
        found = found.withColumn("category", F.when(here & own, made).otherwise(F.col("category")))
        frames = frames.withColumn("tag_prefix", F.when(here, made).otherwise(F.col("tag_prefix")))
    return found.withColumns({c: v for c, v in columns.items() if c in found.columns}), frames.withColumns(columns)


def add_items(items: DataFrame, new: DataFrame, keys: Sequence[str], what: str = "item") -> DataFrame:
    """Items with new ones; a key that is there already, in any case, or twice among the new, is an error."""
    low = [F.lower(F.col(k).cast("string")).alias(k) for k in keys]
    both = items.select(*low).unionByName(new.select(*low)).groupBy(*keys).count().where("count > 1").select(F.concat_ws(" ", *keys).alias("k"))
    return raise_where(items.unionByName(new, allowMissingColumns=True), both, f"there are two of one {what}: ")


def order_tags(cells: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Cells whose frames' tags are numbered by the dictionary's order, unknown ones last by name."""
    places = F.broadcast(dictionary.select(F.col("tag_lc").alias("_full"), F.col("seq").alias("_seq")))
    rows = cells.withColumn("_full", F.lower(F.concat("category", F.lit("."), "tag"))).join(places, "_full", "left")
    order = Window.partitionBy(*KEYS, "kind", "loop_ord", "row_ord").orderBy(F.asc_nulls_last("_seq"), F.lower("tag"))
    nth = (F.row_number().over(order) - 1).cast("int")
    return rows.withColumn("col_ord", F.when(F.col("kind") == "tag", nth).otherwise(F.col("col_ord"))).select(*cells.columns)


def add_missing_tags(cells: DataFrame, frames: DataFrame, dictionary: DataFrame, all_tags: bool = False) -> DataFrame:
    """Cells with every tag that the dictionary has for a frame's category, null where it was missing, in the dictionary's order."""
    known = dictionary.where(~F.col("is_loop") & (F.lit(all_tags) | (F.col("public") != "I"))).select(F.col("sf_category").alias("_c"), F.lower("category").alias("_p"), F.col("tag_field").alias("tag"))
    wanted = frames.join(F.broadcast(known), (F.col("sf_category") == F.col("_c")) & (F.lower("tag_prefix") == F.col("_p"))).withColumn("_low", F.lower("tag"))
    missing = wanted.join(cells.where("kind = 'tag'").select(*KEYS, F.lower("tag").alias("_low")), [*KEYS, "_low"], "left_anti")
    made = missing.select(*KEYS, "sf_name", "sf_category", F.lit("tag").alias("kind"), F.lit(0).cast("long").alias("loop_ord"), F.col("tag_prefix").alias("category"), F.lit(0).cast("long").alias("row_ord"), F.lit(0).alias("col_ord"), "tag", F.lit(None).cast("string").alias("value"))
    names = [c for c in made.columns if c in cells.columns]
    return order_tags(cells.select(*names).unionByName(made.select(*names)), dictionary)


def add_missing_loop_tags(cells: DataFrame, loops: DataFrame, dictionary: DataFrame, all_tags: bool = False) -> tuple[DataFrame, DataFrame]:
    """The (cells, loops) whose loops have every tag that the dictionary has for their category, null where it was missing, in its order.

    Tags that the dictionary does not know follow, by name; loops of unknown categories stay as they are.
    """
    keys = [*KEYS, "loop_ord"]
    known = dictionary.where(F.col("is_loop") & (F.lit(all_tags) | (F.col("public") != "I"))).groupBy(F.lower("category").alias("_c"))
    known = known.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tag_field"))), lambda x: x["tag_field"]).alias("_known"))
    low = lambda tags: F.transform(tags, F.lower)
    joined = loops.join(F.broadcast(known), F.lower("category") == F.col("_c"), "left")
    own = F.transform("_known", lambda t: F.coalesce(F.get(F.filter("tags", lambda x: F.lower(x) == F.lower(t)), F.lit(0)), t))
    others = F.array_sort(F.filter("tags", lambda t: ~F.array_contains(low(F.col("_known")), F.lower(t))))
    new = joined.withColumn("_new", F.when(F.col("_known").isNull(), F.col("tags")).otherwise(F.concat(own, others)))
    held = cells.where("kind = 'loop'")
    rows = held.select("sf_name", "sf_category", *keys, "category", "row_ord").distinct()
    wanted = rows.join(new.select(*keys, "_new"), keys).select("*", F.posexplode("_new").alias("_at", "_tag")).withColumn("_low", F.lower("_tag"))
    values = held.select(*keys, "row_ord", F.lower("tag").alias("_low"), "value")
    filled = wanted.join(values, [*keys, "row_ord", "_low"], "left")
    made = filled.select(*KEYS, "sf_name", "sf_category", F.lit("loop").alias("kind"), "loop_ord", "category", "row_ord", F.col("_at").alias("col_ord"), F.col("_tag").alias("tag"), "value")
    names = [c for c in made.columns if c in cells.columns]
    return cells.where("kind <> 'loop'").select(*names).unionByName(made.select(*names)), new.withColumn("tags", F.col("_new")).select(*loops.columns)


def sizes(frames: DataFrame, loops: DataFrame) -> DataFrame:
    """(entry_id, n_frames, n_loops, n_rows) of every entry."""
    held = loops.groupBy("entry_id").agg(F.count("*").alias("n_loops"), F.sum("n_rows").alias("n_rows"))
    zero = F.lit(0).cast("long")
    return frames.groupBy("entry_id").agg(F.count("*").alias("n_frames")).join(held, "entry_id", "left").select("entry_id", "n_frames", F.coalesce("n_loops", zero).alias("n_loops"), F.coalesce("n_rows", zero).alias("n_rows"))


def as_map(items: DataFrame, group: Sequence[str], key: str, value: str | Column) -> DataFrame:
    """(group, items): a map from key to value of each group; a key twice is an error."""
    return items.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), (F.col(value) if isinstance(value, str) else value).alias("v"))))).alias("items"))
