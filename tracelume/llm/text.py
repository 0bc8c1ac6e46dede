"""Native (JVM-side) word expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates words: space and \t \n \x0b \f \r.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+`` in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def lower_words(text: Column) -> Column:
    """``words(ascii_lower(text))`` in less time: lower case is Spark's own where all is ASCII, and elsewhere white space becomes single blanks in the pass over letters."""
    text = F.coalesce(text, F.lit(""))
    ascii_ = F.split(F.lower(text), SPACE, -1)
    blanks = F.translate(text, UPPER + "\t\n\x0b\x0c\r", LOWER + " " * 5)
    return F.array_remove(F.when(F.octet_length(text) == F.char_length(text), ascii_).otherwise(F.split(blanks, " ", -1)), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc32_text(value: Column) -> Column:
    return F.crc32(value.cast("string").cast("binary"))
