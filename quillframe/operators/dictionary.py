"""The dictionary of tags as a table: reading, templates, ordering, listing and extension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.functions.values import java_pattern
from quillframe.operators.table import ROW, Loop

SCHEMA = (
    "tag string, seq double, sf_category string, is_loop boolean, data_type string, star_type string, nullable boolean, public string, default_value string, "
    "entry_id_flag boolean, local_id_flag boolean, fk_table string, fk_column string, sf_pointer boolean"
)
#: Columns of a dictionary file, in order of this package's schema; positions are parameters since headers repeat.
TYPES = ("VARCHAR", "CHAR", "TEXT", "INTEGER", "FLOAT", "DATETIME YEAR TO DAY")


def from_rows(spark: SparkSession, rows: Sequence[Mapping[str, object]], patterns: Mapping[str, str] | None = None) -> DataFrame:
    """A dictionary of literal rows; attributes not given take defaults. ``patterns`` are those of the types."""
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    base = {"is_loop": False, "data_type": "VARCHAR(255)", "star_type": "any", "nullable": True, "public": "Y", "entry_id_flag": False, "local_id_flag": False, "sf_pointer": False}
    made = [tuple((base | {"seq": float(i)} | dict(r)).get(n) for n in names) for i, r in enumerate(rows)]
    return prepared(spark.createDataFrame(made, SCHEMA), patterns or {})


def prepared(dictionary: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Add what look-ups need: lower-case name, category, short name and the type's pattern."""
    types = dictionary.sparkSession.createDataFrame([(k, java_pattern(v), f"^{v}$") for k, v in (patterns or {"any": ".*"}).items()], "star_type string, pattern string, regex string")
    parts = dictionary.withColumn("tag_lc", F.lower("tag")).withColumn("category", F.substring_index("tag", ".", 1)).withColumn("tag_field", F.substring_index("tag", ".", -1))
    return parts.join(F.broadcast(types), "star_type", "left")


def read_patterns(spark: SparkSession, path: str) -> dict[str, str]:
    """Type patterns from a headerless CSV of name, pattern and comment (a few dozen rows)."""
    read = spark.read.schema("name string, pattern string, comment string").option("escape", '"').option("multiLine", True).csv(path)
    return {r.name: r.pattern for r in read.select("name", "pattern").collect()}


def read_dictionary(spark: SparkSession, path: str, positions: Mapping[str, int], patterns: Mapping[str, str]) -> DataFrame:
    """A dictionary from CSV whose rows stand between markers; ``positions`` gives each attribute's column."""
    width = max(positions.values()) + 1
    lines = spark.read.schema(", ".join(f"c{i} string" for i in range(width))).option("escape", '"').option("multiLine", True).csv(path)
    flag = lambda n: F.col(f"c{positions[n]}") == "Y"
    text = lambda n: F.col(f"c{positions[n]}") if n in positions else F.lit(None).cast("string")
    rows = lines.where(text("seq").rlike("^[0-9.]+$") & text("tag").startswith("_"))
    made = {
        "tag": text("tag"), "seq": text("seq").cast("double"), "sf_category": text("sf_category"), "is_loop": flag("is_loop"), "data_type": text("data_type"), "star_type": text("star_type"),
        "nullable": F.coalesce(text("nullable"), F.lit("")) != "NOT NULL", "public": text("public"), "default_value": text("default_value"),
        **{n: flag(n) if n in positions else F.lit(False) for n in ("entry_id_flag", "local_id_flag", "sf_pointer")}, "fk_table": text("fk_table"), "fk_column": text("fk_column"),
    }
    return prepared(rows.select(*[made[c.strip().split(" ")[0]].alias(c.strip().split(" ")[0]) for c in SCHEMA.split(",")]), patterns)


def category_order(dictionary: DataFrame) -> DataFrame:
    """(category, place): categories by their first tag."""
    first = dictionary.groupBy("category").agg(F.min("seq").alias("seq"))
    return first.select("category", F.row_number().over(Window.orderBy("seq")).alias("place"))


def loop_template(dictionary: DataFrame, category: str, all_tags: bool = False) -> DataFrame:
    """(tag, place): the tags of a loop category in order; internal ones only with ``all_tags``."""
    name = (category if category.startswith("_") else f"_{category}").lower()
    tags = dictionary.where(F.lower("category") == name).where(F.lit(all_tags) | (F.col("public") != "I"))
    return tags.select("tag", F.row_number().over(Window.orderBy("seq")).cast("long").alias("place"))


def loop_from_template(dictionary: DataFrame, category: str, all_tags: bool = False) -> Loop:
    """A loop without rows that has a category's tags, all text; an error if the dictionary has none."""
    tags = [r.tag.partition(".")[2] for r in loop_template(dictionary, category, all_tags).orderBy("place").collect()]
    if not tags:
        raise ValueError(f"the dictionary has no tags of {category}")
    rows = dictionary.sparkSession.createDataFrame([], ", ".join([f"{ROW} long", *[f"`{t}` string" for t in tags]]))
    return Loop(rows, category if category.startswith("_") else f"_{category}", tuple(tags))


def frame_template(dictionary: DataFrame, sf_category: str, name: str, entry_id: str, all_tags: bool = False, default_values: bool = False) -> DataFrame:
    """(tag, value, place): a new saveframe's tags, with its category, name, entry id and, on request, defaults."""
    tags = dictionary.where((F.col("sf_category") == sf_category) & ~F.col("is_loop")).where(F.lit(all_tags) | (F.col("public") != "I"))
    value = (
        F.when(F.lower("tag_field") == "sf_category", F.lit(sf_category)).when(F.lower("tag_field") == "sf_framecode", F.lit(name))
        .when(F.col("entry_id_flag"), F.lit(entry_id)).when(F.lit(default_values), F.col("default_value"))
    )
    return tags.select("tag", value.alias("value"), F.row_number().over(Window.orderBy("seq")).cast("long").alias("place"))


def entry_template(dictionary: DataFrame, entry_id: str, all_tags: bool = False, default_values: bool = False, values: Mapping[str, str] | None = None) -> DataFrame:
    """(sf_category, sf_name, place, tag, value): one saveframe for each category, with its tags and, on request, their defaults.

    ``values`` gives the values of some tags, by their whole names in any case: the version of the format, say.
    """
    first = dictionary.where(~F.col("is_loop")).groupBy("sf_category").agg(F.min("seq").alias("first"))
    frames = first.select("sf_category", F.concat("sf_category", F.lit("_1")).alias("sf_name"), F.row_number().over(Window.orderBy("first")).cast("long").alias("place"))
    tags = dictionary.where(~F.col("is_loop") & (F.lit(all_tags) | (F.col("public") != "I"))).join(frames, "sf_category")
    value = F.when(F.lower("tag_field") == "sf_category", F.col("sf_category")).when(F.lower("tag_field") == "sf_framecode", F.col("sf_name")).when(F.col("entry_id_flag"), F.lit(entry_id)).when(F.lit(default_values), F.col("default_value"))
    for name, given in (values or {}).items():
        value = F.when(F.lower("tag") == name.lower(), F.lit(given)).otherwise(value)
    return tags.select("sf_category", "sf_name", "place", "tag", value.alias("value"))


def listing(dictionary: DataFrame, search: str | None = None) -> DataFrame:
    """(category, seq, line): every tag's name, type, nullability and category, padded to the longest of all, below a line for its prefix.

    ``search`` keeps the tags that hold a text, and the prefixes of these. A prefix's line has no ``seq``.
    """
    null = F.when(F.col("nullable"), F.lit("")).otherwise(F.lit("NOT NULL"))
    shown = dictionary.select("category", "seq", "tag", F.col("tag_field").alias("c0"), F.col("data_type").alias("c1"), null.alias("c2"), F.col("sf_category").alias("c3"))
    widths = shown.agg(*[F.coalesce(F.max(F.length(f"c{i}")), F.lit(0)).alias(f"w{i}") for i in range(4)])
    rows = shown if search is None else shown.where(F.contains("tag", F.lit(search)))
    padded = rows.crossJoin(F.broadcast(widths))  # one row
    line = F.concat(F.lit("  "), *[x for i in range(4) for x in (F.rpad(f"c{i}", F.col(f"w{i}"), F.lit(" ")), F.lit(" " if i < 2 else "  " if i == 2 else ""))])
    prefixes = rows.select("category").distinct().select("category", F.lit(None).cast("double").alias("seq"), F.rpad("category", 30, F.lit(" ")).alias("line"))
    return prefixes.unionByName(padded.select("category", "seq", line.alias("line")))


def extend(dictionary: DataFrame, tag: str, data_type: str, after: str | None = None, **attributes: object) -> DataFrame:
    """Add a tag of a known type, after another or at the end, with defaults for all attributes not given."""
    if "." not in tag or not tag.startswith("_"):
        raise ValueError(f"{tag} is no full tag")
    if not any(data_type.upper().startswith(t) for t in TYPES):
        raise ValueError(f"{data_type} is no data type")
    added = from_rows(dictionary.sparkSession, [{"tag": tag, "data_type": data_type, "star_type": "any", **attributes}]).drop("seq")
    places = dictionary.select("tag_lc", "seq", F.lead("seq").over(Window.orderBy("seq")).alias("next"))
    at = places.where(F.col("tag_lc") == after.lower()) if after else places.orderBy(F.desc("seq")).limit(1)
    seq = at.agg(F.max(F.coalesce((F.col("seq") + F.col("next")) / 2, F.col("seq") + 1))).scalar()
    return dictionary.unionByName(added.withColumn("seq", seq).select(*dictionary.columns))
