"""Names, null-equivalents and references as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as null, and words that have a meaning of their own.
NULL_TEXTS = ("", ".", "?")
RESERVED = ("data_", "save_", "loop_", "stop_", "global_")


def is_null(value: Column) -> Column:
    """Whether a value is null or one of the texts that stand for null."""
    return value.isNull() | value.isin(*NULL_TEXTS)


def format_category(name: Column) -> Column:
    """A category as ``_Category``: an underscore in front, nothing from the first dot on. Null and empty stay."""
    return F.when(name == "", name).otherwise(F.substring_index(F.when(name.startswith("_"), name).otherwise(F.concat(F.lit("_"), name)), ".", 1))


def format_tag(name: Column) -> Column:
    """A tag without its category: what follows the first dot."""
    return F.when(F.instr(name, ".") > 0, F.substring(name, F.instr(name, ".") + 1, F.length(name))).otherwise(name)


def format_tag_lower(name: Column) -> Column:
    """A tag without its category, in lower case, for comparison."""
    return F.lower(format_tag(name))


def strip_reference(value: Column) -> Column:
    """A saveframe's name from a ``$name`` reference."""
    return F.when(value.startswith("$"), F.substring(value, F.lit(2), F.length(value))).otherwise(value)


def as_reference(name: Column) -> Column:
    """A ``$name`` reference to a saveframe."""
    return F.concat(F.lit("$"), strip_reference(name))


def accession(number: Column) -> Column:
    """An accession in lower case without its ``bmr`` prefix."""
    return F.regexp_replace(F.lower(F.trim(number)), "^bmr", "")


def one_line(value: Column) -> Column:
    """A sequence without its newlines."""
    return F.replace(value, F.lit("\n"), F.lit(""))
