"""Words of whole texts as column expressions: runs of anything but the ASCII white space 9-13 and 32."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
_SPACES = " \t\n\x0b\f\r"


def word_list(text: Column) -> Column:
    """The words in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_characters(text: Column) -> Column:
    """Code points in words; 0 for null."""
    return F.coalesce(F.length(F.translate(text, _SPACES, "")), F.lit(0)).cast("long")


def count_of(text: Column, characters: str) -> Column:
    """How often any of the characters occurs; 0 for null."""
    return F.coalesce(F.length(text) - F.length(F.translate(text, characters, "")), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
