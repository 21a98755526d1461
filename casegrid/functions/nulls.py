"""What counts as missing.  The predicates differ on purpose; each operator names the one it uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TRIM = r"^[ \t\r\n]+|[ \t\r\n]+$"


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def trim(c: Column | str) -> Column:
    """Without blanks, tabs and line ends at either side."""
    return F.regexp_replace(text(c), _TRIM, "")


def null_like(c: Column | str) -> Column:
    """Null, blank, or in any case ``null`` or ``[]``."""
    return text(c).isNull() | F.lower(trim(c)).isin("", "null", "[]")


def no_name(c: Column | str) -> Column:
    """Null, empty, or exactly ``null``."""
    return text(c).isNull() | text(c).isin("", "null")


def no_key_name(c: Column | str) -> Column:
    """Null, empty, or ``null`` in any case."""
    return text(c).isNull() | (text(c) == "") | (F.lower(text(c)) == "null")


def no_reference(c: Column | str) -> Column:
    """A scalar that names no case."""
    return text(c).isNull() | F.lower(trim(c)).isin("", "null", "na", "none", "[]")


def no_value(c: Column | str) -> Column:
    """A cell without a value to look for in the source text."""
    return text(c).isNull() | trim(c).isin("", "NA", "NULL", "null")


def some(c: Column | str) -> Column:
    """A value worth keeping when duplicates are merged."""
    return text(c).isNotNull() & (trim(c) != "") & (F.lower(text(c)) != "null")


def null_if_blank(c: Column | str) -> Column:
    return F.nullif(trim(c), F.lit(""))
