"""Normalisation of whole collections: canonical order, renumbered ids, and references that follow.

Stages, each a join or a window over cells of one entry: order frames, loops, rows and tags; number the
frames of a category; note every key's old and new value; rewrite foreign keys; let labels decide the
ids beside them; number loop ids. Later stages win over earlier ones on the same cell. The cells are
written to the shared store by column between stages, each of which reads some of them more than once.
Only cells that a join can change are shuffled for it; what is told of loops and saveframes goes to the
cells beside their column's place, in one join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.lineage import stored
from quillframe.functions.names import is_null
from quillframe.functions.values import is_integer_text, is_number_text
from quillframe.operators.dictionary import category_order
from quillframe.operators.ranking import ranked_within
from quillframe.plans.validate import with_dictionary


def frame_order(frames: DataFrame, cells: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(entry_id, sf_ord, new_ord, frame_id): the place of each saveframe and its number within its category."""
    ids = cells.where((F.col("kind") == "tag") & (F.lower("tag") == "id")).groupBy("entry_id", "sf_ord").agg(F.min_by(F.when(is_integer_text(F.col("value")), F.col("value").try_cast("long")), "col_ord").alias("id"))
    placed = frames.join(F.broadcast(category_order(dictionary)), frames["tag_prefix"] == F.col("category"), "left").join(ids, ["entry_id", "sf_ord"], "left")
    group = F.when(F.col("place").isNotNull(), 0).when(F.col("sf_category").isNotNull(), 1).otherwise(2)
    order = [group, "place", F.sha1("sf_category"), F.asc_nulls_last("id"), "sf_ord"]
    ordered = ranked_within(placed.select("entry_id", "sf_ord", "sf_category", "place", "id"), ["entry_id"], order, "new_ord")
    numbered = ranked_within(ordered.select("entry_id", "sf_ord", "sf_category", "new_ord"), ["entry_id", "sf_category"], ["new_ord"], "frame_id")
    return numbered.withColumn("frame_id", F.col("frame_id").cast("string")).drop("sf_category")


def _ordered(cells: DataFrame, dictionary: DataFrame, order: DataFrame) -> DataFrame:
    """Cells with new loop, row and column ordinals (by dictionary, by ``Ordinal``, by dictionary) and their saveframe's of ``order``.

    Each is ranked over the distinct loops, rows or tags and joined back, so no task holds a loop.
    """
    keys = ["entry_id", "sf_ord", "loop_ord"]
    rows = with_dictionary(cells, dictionary)
    ordinal = F.max(F.when((F.lower("tag") == "ordinal") & (F.col("kind") == "loop"), F.coalesce("value", F.lit(""))))
    of_rows = rows.groupBy(*keys, "row_ord").agg(ordinal.alias("_ordinal"))
    numeric = of_rows.groupBy(*keys).agg(F.min(is_number_text(F.col("_ordinal")).cast("int")).alias("_numeric"))
    keyed = of_rows.join(numeric, keys).withColumn("_number", F.when(F.col("_numeric") == 1, F.col("_ordinal").try_cast("double")))
    new_rows = ranked_within(keyed.select(*keys, "row_ord", "_ordinal", "_number"), keys, ["_number", "_ordinal", "row_ord"], "_row").select(*keys, "row_ord", (F.col("_row") - 1).alias("_row"))
    own_tags = rows.groupBy(*keys, "col_ord").agg(F.first("seq").alias("seq"), F.first(F.when(F.col("seq").isNull(), F.col("tag"))).alias("_tag"))
    new_tags = own_tags.select(*keys, "col_ord", (F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("seq"), "_tag", "col_ord")) - 1).alias("_col"))
    loops = rows.where("kind = 'loop'").groupBy(*keys).agg(F.first("category").alias("category")).join(F.broadcast(category_order(dictionary)), "category", "left")
    place = F.row_number().over(Window.partitionBy("entry_id", "sf_ord").orderBy(F.asc_nulls_last("place"), F.sha1("category"), "loop_ord"))
    new_loops = loops.select(*keys, place.cast("long").alias("_loop"))
    placed = new_tags.join(new_loops, keys, "left").join(order, ["entry_id", "sf_ord"])
    joined = rows.join(new_rows, [*keys, "row_ord"]).join(placed, [*keys, "col_ord"]).drop("sf_ord").withColumnRenamed("new_ord", "sf_ord")
    return joined.drop("row_ord", "col_ord", "loop_ord").withColumnsRenamed({"_row": "row_ord", "_col": "col_ord"}).withColumn("loop_ord", F.coalesce("_loop", F.lit(0).cast("long"))).drop("_loop")


def beside_parent(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows beside ``_parent_value``, the value that ``_parent`` names in their saveframe."""
    return rows.join(parents, ["entry_id", "sf_ord", "_parent"], "left")


def remap(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows whose value is a key of (_table, _column), beside the key's new value ``_new``, which is null for unknown keys."""
    keyed = rows.withColumn("_old", F.col("value"))
    return keyed.join(mapping, ["entry_id", "_table", "_column", "_old"], "left")


def ids_of_labels(rows: DataFrame, ids: DataFrame, label: str, keys: list[str], how: str = "left") -> DataFrame:
    """Rows (keys, label) beside the id that their label's saveframe has."""
    return rows.join(ids, [*[k for k in keys if k in ids.columns], label], how)


def _where(rows: DataFrame, held: Column, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows that ``held`` names with what ``change`` adds to them, and all others as they are, with nulls there."""
    held = F.coalesce(held, F.lit(False))
    return change(rows.where(held)).unionByName(rows.where(~held), allowMissingColumns=True)


def normalize(cells: DataFrame, frames: DataFrame, dictionary: DataFrame, keeps_ids: tuple[str, ...] = ("_Experiment",)) -> tuple[DataFrame, DataFrame]:
    """The (cells, frames) of normalised entries; loops of the categories ``keeps_ids`` keep their own ids."""
    order = stored(frame_order(frames, cells, dictionary))
    names = [c for c in cells.columns]
    rows = _ordered(cells, dictionary, order)
    rows = rows.withColumn("tag", F.coalesce("tag_field", "tag")).withColumn("old", F.col("value"))
    rows = stored(rows.select(*names, "old", "frame_id", "known_tag", "nullable", "star_type", "entry_id_flag", "local_id_flag", "fk_table", "fk_column", "sf_pointer"))

    local, null = F.coalesce("local_id_flag", F.lit(False)), is_null(F.col("value"))
    parent = rows.where("kind = 'tag'").select("entry_id", "sf_ord", F.lower(F.concat(F.substring(F.col("category"), F.lit(2), F.length("category")), F.lit("."), "tag")).alias("_parent"), F.col("value").alias("_parent_value"))
    rows = rows.withColumn("_parent", F.lower(F.concat("fk_table", F.lit("."), "fk_column")))
    rows = _where(rows, F.col("_parent").isNotNull(), lambda held: beside_parent(held, parent))
    value = (
        F.when(local & F.col("entry_id_flag"), F.col("entry_id"))
        .when(local & (F.col("star_type") == "int"), F.when((F.col("kind") == "tag") | null, F.col("frame_id")).otherwise(F.col("value")))
        .when(local & (F.col("kind") == "loop"), F.coalesce("_parent_value", "value"))
        .otherwise(F.col("value"))
    )
    rows = stored(rows.withColumn("value", value).drop("_parent", "_parent_value"))

    key = [F.lower(F.substring(F.col("category"), F.lit(2), F.length("category"))), F.lower("tag")]
    new = F.when(F.col("kind") == "tag", F.col("value")).otherwise(F.col("old"))
    pointed = dictionary.select(F.lower("fk_table").alias("_table"), F.lower("fk_column").alias("_column")).where("_table is not null and _column is not null").distinct()
    keyed = rows.where("known_tag is not null").withColumns(dict(zip(("_table", "_column"), key, strict=True))).join(F.broadcast(pointed), ["_table", "_column"], "left_semi")
    mapping = keyed.groupBy("entry_id", "_table", "_column", F.col("old").alias("_old")).agg(F.max_by(new, F.struct("sf_ord", "loop_ord", "row_ord", "col_ord")).alias("_new"))
    points = F.col("fk_table").isNotNull() & ~F.coalesce("sf_pointer", F.lit(False)) & ~(is_null(F.col("value")) & F.coalesce("nullable", F.lit(True)))
    rows = rows.withColumn("_table", F.when(points, F.lower("fk_table"))).withColumn("_column", F.lower("fk_column"))
    rows = stored(_where(rows, F.col("_table").isNotNull(), lambda held: remap(held, mapping)).withColumn("value", F.coalesce("_new", "value")).drop("_table", "_column", "_old", "_new"))

    frame_ids = rows.where((F.col("kind") == "tag") & (F.lower("tag") == "id")).select("entry_id", F.concat(F.lit("$"), "sf_name").alias("_label"), F.col("value").alias("_id"))
    labels = rows.where((F.col("kind") == "loop") & (F.lower("fk_column") == "sf_framecode")).select("entry_id", "sf_ord", "loop_ord", "row_ord", F.lower("fk_table").alias("_table"), F.col("value").alias("_label"))
    told = ids_of_labels(labels, frame_ids, "_label", ["entry_id"], "inner").groupBy("entry_id", "sf_ord", "loop_ord", "row_ord", "_table").agg(F.max("_id").alias("_id"))
    takes = (F.col("kind") == "loop") & (F.lower("fk_column") == "id") & ~F.coalesce("entry_id_flag", F.lit(False))
    rows = rows.withColumn("_table", F.when(takes, F.lower("fk_table")))
    rows = _where(rows, F.col("_table").isNotNull(), lambda held: held.join(told, ["entry_id", "sf_ord", "loop_ord", "row_ord", "_table"], "left")).withColumn("value", F.coalesce("_id", "value"))

    numbered = (F.col("kind") == "loop") & (F.lower("tag") == "id") & ~F.col("category").isin(*keeps_ids)
    rows = rows.withColumn("value", F.when(numbered, (F.col("row_ord") + 1).cast("string")).otherwise(F.col("value")))
    moved = frames.join(order.select("entry_id", "sf_ord", "new_ord"), ["entry_id", "sf_ord"]).drop("sf_ord").withColumnRenamed("new_ord", "sf_ord")
    return rows.select(*names), moved.select(*frames.columns)


def dangling_keys(cells: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Cells whose foreign key has no primary key in their entry: what normalisation warns of."""
    rows = with_dictionary(cells, dictionary)
    known = rows.where("known_tag is not null").select("entry_id", F.lower(F.substring(F.col("category"), F.lit(2), F.length("category"))).alias("_table"), F.lower("tag").alias("_column"), "value").distinct()
    points = rows.where("fk_table is not null and not coalesce(sf_pointer, false)").where(~is_null(F.col("value")) | ~F.col("nullable"))
    points = points.withColumn("_table", F.lower("fk_table")).withColumn("_column", F.lower("fk_column"))
    return points.join(known, ["entry_id", "_table", "_column", "value"], "left_anti").select("entry_id", "sf_ord", "tag_full", "value")
