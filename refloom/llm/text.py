"""Shared column expressions for the text contracts of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of the contracts: words between ASCII white space, and words
#: of a-z, 0-9 and everything beyond ASCII.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def _split(col: Column, separators: str) -> Column:
    """The words between separators; splitting is several times faster than extracting."""
    return F.array_remove(F.split(col, separators), "")


def plain_words(col: Column) -> Column:
    """Array of the plain words of a text, lower-cased; empty for null."""
    return _split(ascii_lower(F.coalesce(col, F.lit(""))), PLAIN_WORD.replace("[^", "["))


def count_spaced(col: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.size(_split(F.coalesce(col, F.lit("")), SPACED_WORD.replace("[^", "["))).cast("long")
