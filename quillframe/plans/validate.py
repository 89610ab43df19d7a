"""Validation of entries: every broken rule is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions.lineage import cut
from quillframe.functions.values import converted, convertible, first_error
from quillframe.operators.entries import dangling_references, duplicate_names
from quillframe.operators.listing import numbered_lines


def with_dictionary(cells: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Cells beside the dictionary row of their tag, if there is one (one row a tag, broadcast)."""
    known = dictionary.select("tag_lc", F.col("tag").alias("known_tag"), F.col("sf_category").alias("dict_category"), "nullable", "data_type", "star_type", "pattern", "regex", "seq", "tag_field", "entry_id_flag", "local_id_flag", "fk_table", "fk_column", "sf_pointer")
    full = F.concat("category", F.lit("."), "tag")
    return cells.withColumn("tag_full", full).join(F.broadcast(known), F.lower(full) == F.col("tag_lc"), "left")


#: Cells of one wrong value that a join may bring to one task.
MANY = 1_000_000
_JUDGED = ["category", "tag", "value", "sf_category"]


def value_errors(cells: DataFrame, dictionary: DataFrame, explained: bool = False) -> DataFrame:
    """(category, tag, value, sf_category, n, tag_full, message): distinct wrong values, how many cells have them, and the first message.

    Counts combine in tasks, so a value that most cells have is judged once, and patterns run on distinct values only.
    """
    distinct = cells.groupBy(*_JUDGED).agg(F.count("*").alias("n"))
    rows = with_dictionary(distinct, dictionary).withColumn("own_category", F.col("sf_category")).drop("sf_category").withColumnRenamed("dict_category", "sf_category")
    judged = rows.withColumn("message", first_error(F.col("value"), F.col("own_category"), explained)).where("message is not null")
    return judged.select("category", "tag", "value", F.col("own_category").alias("sf_category"), "n", "tag_full", "message")


def cell_errors(cells: DataFrame, dictionary: DataFrame, explained: bool = False) -> DataFrame:
    """Cells that break a rule of the dictionary, with the first message; ``explained`` adds the type's pattern.

    Distinct values are judged once (``value_errors``, checkpointed at once) and joined back: those of more than ``MANY``
    cells, of which there is less than one in ``MANY`` cells, by broadcast, the others by shuffle.
    """
    found = cut(value_errors(cells, dictionary, explained)).withColumnsRenamed({c: f"_{c}" for c in _JUDGED})
    same = F.lit(True)
    for c in _JUDGED:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    columns = ["entry_id", "sf_ord", "loop_ord", "row_ord", "tag_full", "value", "message"]
    hot, rest = found.where(F.col("n") > MANY), found.where(F.col("n") <= MANY)
    return cells.join(F.broadcast(hot), same).select(columns).unionByName(cells.join(rest, same).select(columns))


def width_errors(cells: DataFrame, loops: DataFrame) -> DataFrame:
    """(entry_id, sf_ord, loop_ord, row_ord, n, width) of loop rows that have more or fewer cells than their loop has tags."""
    keys = ["entry_id", "sf_ord", "loop_ord"]
    rows = cells.where("kind = 'loop'").groupBy(*keys, "row_ord").agg(F.count("*").alias("n"))
    return rows.join(loops.select(*keys, F.size("tags").cast("long").alias("width")), keys).where("n <> width")


def validate(cells: DataFrame, frames: DataFrame, loops: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(entry_id, message): duplicate names, dangling references, missing categories, ragged rows and dictionary errors."""
    named = duplicate_names(frames).select("entry_id", F.concat(F.lit("Several saveframes are named "), "sf_name").alias("message"))
    dangling = dangling_references(cells, frames).select("entry_id", F.concat(F.lit("Dangling saveframe reference "), "value", F.lit(" in "), "category", F.lit("."), "tag").alias("message"))
    uncategorised = frames.where("sf_category is null").select("entry_id", F.concat(F.lit("Saveframe without category: "), "sf_name").alias("message"))
    ragged = width_errors(cells, loops).select("entry_id", F.concat(F.lit("Wrong number of values in row "), F.col("row_ord").cast("string")).alias("message"))
    return named.unionByName(dangling).unionByName(uncategorised).unionByName(ragged).unionByName(cell_errors(cells, dictionary).select("entry_id", "message"))


def validation_report(messages: DataFrame) -> DataFrame:
    """(n, line): the messages of ``validate`` as numbered lines, by entry and text; one line when there is none."""
    order = ["entry_id", "message"]
    found = numbered_lines(messages.select(*order, F.col("message").alias("line")), order, "No problems found during validation.")
    return found.withColumn("line", F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(": "), "line")).otherwise(F.col("line")))


def convert(cells: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Cells with ``typed``, the canonical text of their type, and ``convertible``; unknown tags stay as they are."""
    rows = with_dictionary(cells, dictionary)
    return rows.select(*cells.columns, F.when(F.col("data_type").isNull(), F.col("value")).otherwise(converted(F.col("value"), F.col("data_type"))).alias("typed"), F.coalesce(convertible(F.col("value"), F.col("data_type")), F.lit(True)).alias("convertible"))
