"""Character spans of pattern matches, with column functions only.

A span is ``struct<start, place, end, kind>`` in code points, end exclusive; ``place`` is the kind's place in its list,
so that arrays of spans sort as asked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlens.llm.exprs import let

SPAN = "struct<start:int,place:int,end:int,kind:string>"
FOUND = "struct<start:int,end:int,match:string,before:string>"


def none(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def scanned(items: Column, begin: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """What ``step`` puts out over ``items`` in their order: it maps a state and an item to ``struct<state, out: array<kind>>``.

    An array that grows is copied whole at each step; so the items are taken in blocks of about the square root of their
    number, each of which grows an array of its own.
    """

    def over(part: Column, state: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            return let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))

        return F.aggregate(part, F.struct(state.alias("state"), none(kind).alias("out")), one)

    def blocks(own: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(own))).cast("int")

        def block(acc: Column, at: Column) -> Column:
            part = over(F.slice(own, at, size), acc["state"])
            return let(part, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        start = F.struct(begin.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(own), size), start, block, lambda acc: F.flatten(acc["out"]))

    return let(items, lambda own: F.when(F.size(own) == 0, none(kind)).otherwise(blocks(own)))


def matches(text: Column, pattern: str, when: Column | None = None) -> Column:
    """``array<FOUND>`` of the leftmost non-overlapping matches of a Java pattern that matches no empty string.

    The pieces between the matches come from a split by the same pattern, so running lengths give the positions.
    ``before`` is the text since the previous match. ``when`` is a cheap condition without which nothing matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(at: Column, x: Column) -> Column:
        start = at + F.length(x["before"])
        end = start + F.length(x["match"])
        one = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), x["before"].alias("before"))
        return F.struct(end.alias("state"), F.array(one).alias("out"))

    def of(m: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        pieces = F.zip_with(m, gaps, lambda x, gap: F.struct(x.alias("match"), gap.alias("before")))
        return scanned(pieces, F.lit(0), placed, FOUND)

    some = let(found, lambda m: F.when(F.size(m) == 0, none(FOUND)).otherwise(of(m)))
    return some if when is None else F.when(when, some).otherwise(none(FOUND))


def spans(found: Column, kind: str, place: int, valid: Callable[[Column], Column]) -> Column:
    """``array<SPAN>`` of those ``found`` whose ``match`` is ``valid``."""
    good = F.filter(found, lambda x: valid(x["match"]))
    span = lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("place"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    return F.transform(good, span)


def clear_of(found: Column, others: Column) -> Column:
    """Those ``found`` that overlap none of the spans ``others``; one pass over both in the order of their begins.

    ``found`` don't overlap each other. One waits until the next begins: it goes if a span of ``others`` reaches beyond its
    begin, or begins before its end.
    """
    item = lambda x, own: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), (x["match"] if own else F.lit("")).alias("match"), (x["before"] if own else F.lit("")).alias("before"))
    last = F.struct(F.lit(2**31 - 1).alias("start"), F.lit(1).alias("own"), F.lit(2**31 - 1).alias("end"), F.lit("").alias("match"), F.lit("").alias("before"))

    def step(state: Column, x: Column) -> Column:
        waits = state["waits"]
        ready = F.when((x["own"] == 1) & state["clear"], F.array(waits)).otherwise(none(FOUND))
        own = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), x["before"].alias("before"))
        after = F.when(
            x["own"] == 1, F.struct(state["reach"].alias("reach"), (state["reach"] <= x["start"]).alias("clear"), own.alias("waits"))
        ).otherwise(F.struct(F.greatest(state["reach"], x["end"]).alias("reach"), (state["clear"] & (x["start"] >= waits["end"])).alias("clear"), waits.alias("waits")))
        return F.struct(after.alias("state"), ready.alias("out"))

    begin = F.struct(F.lit(0).alias("reach"), F.lit(False).alias("clear"), F.lit(None).cast(FOUND).alias("waits"))
    every = F.sort_array(F.concat(F.transform(others, lambda x: item(x, 0)), F.transform(found, lambda x: item(x, 1))))
    both = let(F.concat(every, F.array(last)), lambda items: scanned(items, begin, step, FOUND))
    return F.when((F.size(found) == 0) | (F.size(others) == 0), found).otherwise(both)


def joined(sorted_spans: Column) -> Column:
    """``kind:start:end`` of all, comma-joined."""
    one = lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))
    return F.array_join(F.transform(sorted_spans, one), ",")


def count_of(all_spans: Column, kind: str) -> Column:
    return F.size(F.filter(all_spans, lambda x: x["kind"] == kind)).cast("long")
