"""Quoting of values, escaping of embedded text blocks, and newline repair, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[ \\n\\t\\x0B]"
_KEYWORD = "(?i)^(data_|save_|loop_|stop_|global_)"


def normalise_newlines(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\\r\\n?", "\n")


def repair_block_starts(text: Column) -> Column:
    """Move text that shares its line with an opening semicolon to a line of its own, where the line stands alone."""
    return F.regexp_replace(text, "\\n;([^\\n]+?)\\n", "\n;\n$1\n")


def escape_block(value: Column) -> Column:
    """Indent a text that holds a closing delimiter, between newlines."""
    moved = F.replace(value, F.lit("\n"), F.lit("\n   "))
    moved = F.when(moved.startswith("\n"), moved).otherwise(F.concat(F.lit("\n   "), moved))
    return F.when(moved.endswith("\n"), moved).otherwise(F.concat(moved, F.lit("\n")))


def unescape_block(value: Column) -> Column:
    """Undo ``escape_block`` where every line is indented and a closing delimiter is held; else unchanged."""
    body = F.substring(value, F.lit(1), F.length(value) - 1)
    held = value.startswith("\n   ") & ~body.rlike("\\n(?!   )") & F.contains(value, F.lit("\n   ;"))
    return F.when(held, F.replace(body, F.lit("\n   "), F.lit("\n"))).otherwise(value)


def quote_value(value: Column, nulls: dict[str | None, str] | None = None) -> Column:
    """A value as it is written: quoted, or a text block (which ends with a newline), or bare. Null is a dot, empty an error.

    ``nulls`` maps values, null among them, to others before they are written.
    """
    for old, new in (nulls or {}).items():
        value = F.when(value.isNull() if old is None else value == old, F.lit(new)).otherwise(value)
    single, double = F.contains(value, F.lit("'")), F.contains(value, F.lit('"'))
    in_single, in_double = F.concat(F.lit("'"), value, F.lit("'")), F.concat(F.lit('"'), value, F.lit('"'))
    needed = value.rlike("^[_\"'#]") | value.rlike(_KEYWORD) | value.rlike(SPACE)
    return (
        F.when(value.isNull(), F.lit("."))
        .when(value == "", F.raise_error(F.lit("an empty text is no valid value")))
        .when(F.contains(value, F.lit("\n;")), escape_block(value))
        .when(F.contains(value, F.lit("\n")), F.when(value.endswith("\n"), value).otherwise(F.concat(value, F.lit("\n"))))
        .when(single & double, F.when(~value.rlike("'" + SPACE), in_single).when(~value.rlike('"' + SPACE), in_double).otherwise(F.concat(value, F.lit("\n"))))
        .when(needed, F.when(single, in_double).otherwise(in_single))
        .otherwise(value)
    )
