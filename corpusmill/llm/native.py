"""Expressions on words that stay within Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that ends words: \x20 and \x09-\x0D.
BLANK = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{BLANK}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often and deep body uses it."""
    return F.transform(F.array(value), body)[0]
