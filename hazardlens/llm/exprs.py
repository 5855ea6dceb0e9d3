"""Column builders shared by the native text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once (Catalyst may otherwise repeat it per use and per lambda call)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the maximal runs without white space; empty for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def n_chars_of(text: Column, chars: str) -> Column:
    """How many code points of ``text`` are in ``chars`` (each one code point)."""
    return (F.length(text) - F.length(without(text, chars))).cast("long")


def spare(docs: DataFrame, *names: str) -> list[str]:
    """Working names like ``names`` that no column of ``docs`` has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
