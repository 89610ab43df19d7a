"""Typed conversion and validation of values against a dictionary, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions.names import is_null


def is_integer_text(value: Column) -> Column:
    """Whether a value reads as an integer."""
    return value.rlike("^[+-]?[0-9]+$")


def is_number_text(value: Column) -> Column:
    """Whether a value reads as a number; Java's suffixes (``1d``) do not count."""
    return value.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$") | F.lower(value).rlike("^[+-]?(inf|infinity|nan)$")


def as_integer(value: Column) -> Column:
    """The integer of a value; null-equivalents and other texts are null."""
    return F.when(is_integer_text(value), value.try_cast("long"))


def as_number(value: Column) -> Column:
    """The double of a value; null-equivalents and other texts are null. The text keeps the written scale."""
    return F.when(is_number_text(value), value.try_cast("double"))


def as_date(value: Column) -> Column:
    """The date of ``year-month-day``."""
    return F.try_to_date(value, "y-M-d")


def convertible(value: Column, data_type: Column) -> Column:
    """Whether a value can be converted to its dictionary type; null-equivalents can."""
    return (
        is_null(value)
        | F.when(F.contains(data_type, F.lit("CHAR")) | F.contains(data_type, F.lit("TEXT")), True)
        .when(F.contains(data_type, F.lit("INTEGER")), is_integer_text(value))
        .when(F.contains(data_type, F.lit("FLOAT")), is_number_text(value))
        .when(F.contains(data_type, F.lit("DATETIME year to day")), as_date(value).isNotNull())
        .otherwise(True)
    )


def converted(value: Column, data_type: Column) -> Column:
    """A value as the canonical text of its type: null for null-equivalents, digits for integers, ISO dates."""
    return F.when(~is_null(value), F.when(F.contains(data_type, F.lit("INTEGER")), as_integer(value).cast("string")).when(F.contains(data_type, F.lit("DATETIME year to day")), as_date(value).cast("string")).otherwise(value))


def typed(value: Column, data_type: str, strict: bool = False) -> Column:
    """A value in the Spark type of its dictionary type; what does not convert is null, or an error with ``strict``."""
    kind = next((k for k in ("INTEGER", "FLOAT", "DATETIME year to day") if k in data_type), None)
    made = {"INTEGER": F.when(is_integer_text(value), value.try_cast("decimal(38,0)")), "FLOAT": as_number(value), "DATETIME year to day": as_date(value)}.get(kind, value)
    if strict and kind:
        made = F.when(is_null(value) | made.isNotNull(), made).otherwise(F.raise_error(F.concat(F.lit(f"no {data_type}: "), value)).cast(made_type(kind)))
    return F.when(~is_null(value), made)


def made_type(kind: str) -> str:
    """The Spark type of a kind of dictionary type."""
    return {"INTEGER": "decimal(38,0)", "FLOAT": "double", "DATETIME year to day": "date"}[kind]


def java_pattern(pattern: str) -> str:
    """A dictionary pattern for Java: anchored, only LF as line end, and a bracket first in a class escaped."""
    return "(?d)^" + pattern.replace("[][", "[\\]\\[") + "$"


#: What follows the message on a value that does not match its type's pattern.
_TYPE_LINES = ("\n     Type specified: ", "\n     Regular expression for type: '", "'")


def first_error(value: Column, category: Column | None = None, explained: bool = False) -> Column:
    """The first rule that a value breaks, by the dictionary columns of its row; null if it breaks none.

    Reads ``tag_full`` and the dictionary's ``known_tag``, ``sf_category``, ``nullable``, ``data_type``,
    ``star_type`` and ``pattern`` (null where the tag is unknown). With ``explained``, a value that does not match is
    told with its type and that type's pattern, as written in ``regex``.
    """
    more = F.concat(F.lit(_TYPE_LINES[0]), F.col("star_type"), F.lit(_TYPE_LINES[1]), F.col("regex"), F.lit(_TYPE_LINES[2])) if explained else F.lit("")
    length = F.regexp_extract("data_type", "CHAR\\(([0-9]+)\\)", 1).try_cast("int")
    wrong = F.when(F.col("known_tag").isNull(), F.concat(F.lit("Tag '"), F.col("tag_full"), F.lit("' not found in schema.")))
    if category is not None:
        message = F.concat(F.lit("The tag '"), F.col("known_tag"), F.lit("' in category '"), category, F.lit("' should be in category '"), F.col("sf_category"), F.lit("'."))
        wrong = wrong.when(category != F.col("sf_category"), message)
    shown = F.concat(F.col("known_tag"), F.lit("':'"), F.coalesce(value, F.lit(".")), F.lit("'."))
    return (
        wrong.when(is_null(value) & ~F.col("nullable"), F.concat(F.lit("Value cannot be NULL but is: "), shown))
        .when(is_null(value), F.lit(None).cast("string"))
        .when(F.length(value) > length, F.concat(F.lit("Length of '"), F.length(value).cast("string"), F.lit("' is too long for '"), F.col("data_type"), F.lit("': '"), shown))
        .when(~F.coalesce(F.regexp_like(value, F.col("pattern")), F.lit(True)), F.concat(F.lit("Value does not match specification: '"), shown, more))
        .when(F.col("tag_full") != F.col("known_tag"), F.concat(F.lit("The tag '"), F.col("tag_full"), F.lit("' is improperly capitalized but otherwise valid. Should be '"), F.col("known_tag"), F.lit("'.")))
    )
