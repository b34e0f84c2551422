"""Matches of a pattern with their places, in built-in functions only.

Spark has no function that gives the offsets of all matches, but the text between matches is what ``split``
returns, so offsets are running sums of lengths of gaps and matches. Offsets count code points; ends are
exclusive. Nothing here costs the square of the number of matches or of the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind:int,end:int,match:string>>"
#: Code points in a block of a text that is cut to reach its parts.
BLOCK = 1024


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Element k joins the elements 0 to k of ``values``.

    Each turn doubles how far back an element reaches, so n elements take n log n steps; an array that a fold
    appends to would be copied for each element.
    """

    def turn(all_: Column, reach: Column) -> Column:
        return F.transform(all_, lambda x, i: F.when(i >= reach, join(F.get(all_, i - reach), x)).otherwise(x))

    powers = F.array(*[F.lit(1 << k) for k in range(31)])
    return bound(values, lambda v: F.aggregate(F.filter(powers, lambda p: p < F.size(v)), v, turn))


def located(text: Column, pattern: str | Column, kind: int) -> Column:
    """Array of (start, kind, end, match) of the leftmost matches that don't overlap; none match the empty text."""
    fixed = isinstance(pattern, str)
    regex = F.lit(pattern) if fixed else pattern
    gaps, found = F.split(text, regex, -1), F.regexp_extract_all(text, regex, F.lit(0))
    # There is one gap more than matches.
    pairs = F.filter(F.zip_with(gaps, found, lambda g, m: F.struct((F.length(g) + F.length(m)).alias("size"), m.alias("match"))), lambda p: p["match"].isNotNull())

    def placed(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda p: p["size"]), lambda a, b: a + b)
        return F.zip_with(pairs, ends, lambda p, end: F.struct((end - F.length(p["match"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["match"].alias("match")))

    return F.when(text.rlike(pattern) if fixed else F.regexp_like(text, regex), bound(pairs, placed)).otherwise(F.array().cast(SPAN))


def in_blocks(text: Column) -> Column:
    """The text as an array of blocks, for ``part``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` (exclusive, not before start) of a text in blocks; costs no more than what it returns and two blocks."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.ceil(end / BLOCK).cast("int") - first)
    return F.when(end > start, F.substring(F.array_join(some, ""), start - first * BLOCK + 1, end - start)).otherwise("")


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of each span, joined by commas, in the order of the array."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
