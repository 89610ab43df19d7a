"""Operations on whole entries: the cell tables of many saveframes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.names import is_null, strip_reference
from quillframe.operators.frames import raise_where

#: Tags that say what a saveframe is and do not make it non-empty.
STRUCTURAL = ("sf_category", "sf_framecode", "id", "entry_id", "nmr_star_version", "original_nmr_star_version")


def lowered(cells: DataFrame, name: str) -> Column:
    """A name in lower case: the stored column, which a scan can prune by, where there is one."""
    return F.col(f"{name}_lc") if f"{name}_lc" in cells.columns else F.lower(name)


def _same(cells: DataFrame, name: str, value: str) -> Column:
    return lowered(cells, name) == F.lit(value.lower())


def loops_by_category(cells: DataFrame, category: str) -> DataFrame:
    """Cells of all loops of a category, in any case and with or without its underscore."""
    name = category if category.startswith("_") else f"_{category}"
    return cells.where((F.col("kind") == "loop") & _same(cells, "category", name.partition(".")[0]))


def get_tags(cells: DataFrame, names: Iterable[str]) -> DataFrame:
    """(entry_id, name, sf_ord, loop_ord, row_ord, value) of qualified tags: loops of the category come before a frame's own tags."""
    wanted = []
    for name in names:
        category, dot, tag = name.partition(".")
        if not dot:
            raise ValueError(f"{name} names no category")
        wanted.append((name, (category if category.startswith("_") else f"_{category}").lower(), tag.lower()))
    asked = F.broadcast(cells.sparkSession.createDataFrame(wanted, "name string, _c string, _t string"))
    category, tag = lowered(cells, "category"), lowered(cells, "tag")
    some = cells.where(category.isin(*{c for _, c, _ in wanted}) & tag.isin(*{t for _, _, t in wanted})) if wanted else cells
    found = some.join(asked, (category == F.col("_c")) & (tag == F.col("_t")))
    return found.select("entry_id", "name", "sf_ord", "loop_ord", "row_ord", "value")


def frames_by_tag_value(cells: DataFrame, tag: str, value: str) -> DataFrame:
    """(entry_id, sf_ord) of the saveframes whose first value of a tag is the given one."""
    first = Window.partitionBy("entry_id", "sf_ord").orderBy(F.desc("kind"), "loop_ord", "row_ord")
    hits = cells.where(_same(cells, "tag", tag.rpartition(".")[2]) & (_same(cells, "category", tag.partition(".")[0]) if "." in tag else F.lit(True)))
    return hits.withColumn("nth", F.row_number().over(first)).where((F.col("nth") == 1) & (F.col("value") == value)).select("entry_id", "sf_ord")


def category_list(frames: DataFrame) -> DataFrame:
    """(entry_id, sf_category, nth): distinct categories in the order of their first saveframe."""
    seen = frames.where("sf_category is not null").groupBy("entry_id", "sf_category").agg(F.min("sf_ord").alias("first"))
    return seen.withColumn("nth", F.row_number().over(Window.partitionBy("entry_id").orderBy("first"))).drop("first")


def duplicate_names(frames: DataFrame) -> DataFrame:
    """(entry_id, sf_name, count) of names that several saveframes of an entry have."""
    return frames.groupBy("entry_id", "sf_name").count().where("count > 1")


def empty_frames(cells: DataFrame, frames: DataFrame, structural: Sequence[str] = STRUCTURAL) -> DataFrame:
    """(entry_id, sf_ord) of saveframes all of whose values are null-equivalent, structural tags (whole names, lower case) aside."""
    held = cells.where(~is_null(F.col("value")) & ~((F.col("kind") == "tag") & F.lower("tag").isin(*structural))).select("entry_id", "sf_ord").distinct()
    return frames.select("entry_id", "sf_ord").join(held, ["entry_id", "sf_ord"], "left_anti")


def remove_empty_frames(cells: DataFrame, frames: DataFrame, structural: Sequence[str] = STRUCTURAL) -> tuple[DataFrame, DataFrame]:
    """The (cells, frames) without the saveframes that hold nothing but structural tags."""
    gone = empty_frames(cells, frames, structural)
    return tuple(x.join(gone, ["entry_id", "sf_ord"], "left_anti").select(*x.columns) for x in (cells, frames))


def dangling_references(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """Cells whose ``$name`` names no saveframe of their entry. Text blocks are no references."""
    references = cells.where(F.col("value").startswith("$")).withColumn("sf_name_wanted", strip_reference(F.col("value")))
    names = frames.select("entry_id", F.col("sf_name").alias("sf_name_wanted"))
    return references.join(names, ["entry_id", "sf_name_wanted"], "left_anti").drop("sf_name_wanted")


def rename_frame(cells: DataFrame, frames: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Rename a saveframe and every reference to it; another saveframe of the new name is an error."""
    old, new = old.removeprefix("$"), new.removeprefix("$")
    taken = frames.where((F.col("sf_name") == new) & F.lit(old != new)).select("sf_name")
    frames = raise_where(frames, taken, "there is a saveframe ")
    own = (F.col("sf_name") == old) & (F.col("kind") == "tag") & (F.lower("tag") == "sf_framecode")
    value = F.when(F.col("value") == f"${old}", F.lit(f"${new}")).when(own, F.lit(new)).otherwise(F.col("value"))
    name = F.when(F.col("sf_name") == old, F.lit(new)).otherwise(F.col("sf_name"))
    return cells.withColumn("value", value).withColumn("sf_name", name), frames.withColumn("sf_name", name)


def set_entry_id(cells: DataFrame, dictionary: DataFrame, entry_id: str) -> DataFrame:
    """Write an entry's id into every tag that the dictionary flags for it."""
    flagged = F.broadcast(dictionary.where("entry_id_flag").select(F.col("tag_lc").alias("_tag")).distinct())
    joined = cells.join(flagged, F.lower(F.concat("category", F.lit("."), "tag")) == F.col("_tag"), "left")
    return joined.withColumn("value", F.when(F.col("_tag").isNotNull(), F.lit(entry_id)).otherwise(F.col("value"))).drop("_tag").withColumn("entry_id", F.lit(entry_id))


def remove_items(rows: DataFrame, key: str, items: Iterable[str]) -> DataFrame:
    """Rows without those of the given keys; all keys must exist."""
    wanted = rows.sparkSession.createDataFrame([(i,) for i in items], f"{key} string")
    return raise_where(rows.join(F.broadcast(wanted), key, "left_anti"), wanted.join(rows.select(key), key, "left_anti"), "there is no ")


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with those of the same key replaced, and new ones added."""
    return rows.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def contains_all(rows: DataFrame, key: str, items: Iterable[str]) -> DataFrame:
    """One row: whether every item is among the keys, in any case."""
    wanted = rows.sparkSession.createDataFrame([(i.lower(),) for i in items], "_item string")
    found = rows.select(F.lower(key).alias("_item")).distinct()
    return wanted.join(found, "_item", "left_anti").agg((F.count("*") == 0).alias("all_there"))
