"""Joins, windows and aggregates that the query catalogue is made of."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank_in_group") -> DataFrame:
    """Position of each row among those of equal ``keys``; ``order`` must be total for a stable result."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in ``order``."""
    return ranked(df, keys, order).where("rank_in_group = 1").drop("rank_in_group")


def others_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows but the first of each group: what a newer version replaces."""
    return ranked(df, keys, order).where("rank_in_group > 1").drop("rank_in_group")


def latest_by(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of each group with the greatest value of ``by``, by aggregation with partial results on the map side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("r"))
    return picked.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def any_of(conditions: list[Column]) -> Column:
    """Disjunction of the conditions that are wanted; false without any."""
    return reduce(or_, conditions, F.lit(False))


def facets(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(facet, value, n) of several columns in one pass; empty values are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("facet"), F.col(c).cast("string").alias("value")) for name, c in columns.items()]))
    return df.select(each.alias("f")).select("f.*").where("value <> ''").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def tally(df: DataFrame, keys: list[str], kind: str, kinds: dict[str, str], member: str, weight: str, name: str, roll_call: Column) -> DataFrame:
    """Votes of each decision by kind: single votes count 1 in a roll call, else their group's weight; and who voted so.

    A decision is a roll call if any of its rows is one.
    """
    call = F.max(roll_call)
    out = [call.alias("roll_call")]
    for value, label in kinds.items():
        on = F.col(kind) == value
        heads, sums = F.count_if(on), F.coalesce(F.sum(F.when(on, F.col(weight))), F.lit(0)).cast("long")
        out.append(F.when(call, heads).otherwise(sums).alias(f"n_{label}"))
        who = F.collect_set(F.when(on, F.when(roll_call, F.col(member)).otherwise(F.col(name))))
        out.append(F.array_join(F.array_sort(who), ",").alias(f"who_{label}"))
    return df.groupBy(*keys).agg(*out)


def in_blocks(edges: DataFrame, start: str, middle: str, block: int) -> DataFrame:
    """(start, middle, part, parts): the starts of each middle dealt into parts of about ``block``; most middles are one part."""
    parts = edges.groupBy(middle).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    return edges.join(parts, middle).withColumn("part", F.pmod(F.xxhash64(start), "parts").cast("int")).select(start, middle, "part", "parts")


def two_hops(edges: DataFrame, start: str, middle: str, of: DataFrame | None = None, block: int = 1000) -> DataFrame:
    """(a, b) pairs of different starts that share a middle, once; with ``of`` (a column named as ``start``), pairs of those as a only.

    The starts of a middle are dealt into parts of about ``block``, and two parts meet under a key of their own. So a
    middle with d starts is spread over (d / block)^2 keys, each with at most about block^2 pairs, and its rows are
    copied d / block times. Rows without a start or a middle have no pair.
    """
    known = edges.select(F.col(start).alias("a"), F.col(middle).alias("middle")).dropna().distinct()
    placed = in_blocks(known, "a", "middle", block)
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    one, two = placed.select("a", "middle", F.col("part").alias("p"), every.alias("q")), placed.select(F.col("a").alias("b"), "middle", F.col("part").alias("q"), every.alias("p"))
    if of is not None:
        one = one.join(of.select(F.col(start).alias("a")).distinct(), "a", "left_semi")
        return one.join(two, ["middle", "p", "q"]).where("a <> b").select("a", "b").distinct()
    # Each pair is found and made distinct in one direction and turned round at the end.
    pairs = one.join(two, ["middle", "p", "q"]).where("a < b").select("a", "b").distinct()
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return pairs.select(both.alias("x")).select("x.a", "x.b")


def within_interval(facts: DataFrame, spans: DataFrame, key: str | list[str], at: str, begin: str, end: str, step: int = 4) -> DataFrame:
    """Facts joined with the spans of the same key that hold them: begin < at <= end, an open end holds all.

    A span belongs to the level whose buckets are at least as long as it is, and lies in one or two buckets
    there; a fact lies in one bucket of each level in use. Levels are ``step`` bits apart, so there are at most
    64 / step and a bucket is at most 2^step times as long as its spans. A fact meets only spans near it, and a
    key with many facts and spans is spread over buckets. Open spans are a level of one bucket.
    """
    keys = [key] if isinstance(key, str) else key
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    place = lambda c: F.when(F.col("__level") < 0, F.lit(0).cast("long")).otherwise(F.floor(micros(c) / F.pow(F.lit(2.0), F.col("__level"))))
    length = F.log2(F.greatest(micros(end) - micros(begin), F.lit(1)))
    level = F.when(F.col(end).isNull(), -1).otherwise(F.ceil(length / step).cast("int") * step)
    levelled = spans.withColumn("__level", level)
    levels = levelled.agg(F.collect_set("__level").alias("__levels"))
    levelled = levelled.withColumn("__bucket", F.explode(F.array_distinct(F.array_compact(F.array(place(begin), place(end))))))
    placed = facts.join(F.broadcast(levels)).withColumn("__level", F.explode("__levels")).withColumn("__bucket", place(at)).drop("__levels")
    joined = placed.join(levelled, [*keys, "__level", "__bucket"]).where((F.col(begin) < F.col(at)) & ((F.col(at) <= F.col(end)) | F.col(end).isNull()))
    return joined.drop("__level", "__bucket")


def zero_filled_share(facts: DataFrame, group: str, part: str, value: str) -> DataFrame:
    """(group, part, total, share) for every group and every part of the whole table; share is the percentage within the group.

    Parts and groups both come from one row for each group, so ``facts`` are worked out once. A null part is none, and
    a null group has no totals.
    """
    sums = facts.groupBy(group, part).agg(F.sum(value).alias("total"))
    rows = sums.groupBy(group).agg(F.collect_list(F.when(F.col(part).isNotNull(), F.struct(part, "total"))).alias("__sums"))
    parts = rows.select(F.explode("__sums").alias("s")).agg(F.array_sort(F.collect_set(f"s.{part}")).alias("parts"))
    totals = F.when(F.col(group).isNotNull(), F.map_from_entries("__sums"))
    filled = rows.withColumn("__sums", totals).join(F.broadcast(parts)).select(group, F.explode("parts").alias(part), "__sums")
    filled = filled.select(group, part, F.coalesce(F.try_element_at("__sums", F.col(part)), F.lit(0)).alias("total"))
    whole = F.sum("total").over(Window.partitionBy(group))
    return filled.withColumn("share", F.when(whole == 0, F.lit(0.0)).otherwise(F.lit(100.0) * F.col("total") / whole))


def smallest_window(df: DataFrame, at: str, as_of: Column, days: list[int], least: int) -> DataFrame:
    """Rows of the shortest of the windows of ``days`` before ``as_of`` that holds at least ``least`` rows, with its
    length as ``window_days``; no rows if none does. All windows are counted in one pass."""
    age = F.date_diff(F.lit(as_of) if not isinstance(as_of, Column) else as_of, F.col(at).cast("date"))
    rows = df.withColumn("age_days", age)
    counts = rows.agg(*[F.count_if(F.col("age_days").between(0, d)).alias(f"d{d}") for d in days])
    chosen = F.lit(None).cast("int")
    for d in reversed(days):
        chosen = F.when(F.col(f"d{d}") >= least, F.lit(d)).otherwise(chosen)
    chosen = counts.select(chosen.alias("window_days")).where("window_days IS NOT NULL")
    return rows.join(F.broadcast(chosen)).where(F.col("age_days").between(0, F.col("window_days"))).drop("age_days")


def _neighbours(rows: DataFrame, slot: list[str], width: int) -> DataFrame:
    """``rows`` with ``before`` and ``after``: the last ``__r`` at or before their ``__at`` and the first at or after it, of their ``slot``.

    Rows are sorted within stretches of ``width`` microseconds only; what lies in other stretches comes from one row
    for each stretch, so a crowded slot is spread over its stretches.
    """
    rows = rows.withColumn("__day", F.floor(F.col("__at") / width))
    stretch = Window.partitionBy(*slot, "__day")
    up, down = stretch.orderBy("__at").rangeBetween(Window.unboundedPreceding, 0), stretch.orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, 0)
    days = rows.groupBy(*slot, "__day").agg(F.max("__r").alias("last"), F.min("__r").alias("first"))
    past, future = [Window.partitionBy(*slot).orderBy(order).rowsBetween(Window.unboundedPreceding, -1) for order in (F.asc("__day"), F.desc("__day"))]
    days = days.select(*slot, "__day", F.max("last").over(past).alias("__past"), F.min("first").over(future).alias("__future"))
    here = rows.withColumns({"__up": F.max("__r").over(up), "__down": F.min("__r").over(down)}).where("__r IS NULL")
    return here.join(days, [*slot, "__day"]).withColumns({"before": F.coalesce("__up", "__past"), "after": F.coalesce("__down", "__future")})


def nearest(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, left_size: str, right_size: str, pick: str, ratio: float = 10.0, width: int = 86_400_000_000) -> DataFrame:
    """For each left row the ``pick`` of the right row of the same key that is nearest in time, with ``gap`` in microseconds,
    among those whose size is over 1 / ``ratio`` and under ``ratio`` times the left one's. Ties go to the smaller ``pick``.

    Sizes are dealt into classes, three to a factor of ``ratio``: rows of the same class or the next ones always fit, so
    there the nearest are the neighbours in a common order by time (``_neighbours``). Two more classes on either side
    may fit; their rows are tested only if they are no farther off than what was found already. So pairs are made of
    few rows near in time, not of a key; only a left row without any fit in the three middle classes meets the four
    outer ones of its key in full. Equal left rows become one; rows without key, time or positive size have no match.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cell = lambda c: F.floor(F.log(F.col(c)) / F.log(F.lit(ratio)) * 3)
    able = lambda df, at, size: df.where(F.col(key).isNotNull() & F.col(at).isNotNull() & (F.col(size) > 0) & (F.col(size) < float("inf")))
    own = F.struct(*[F.col(c) for c in left.columns])
    lefts = able(left, left_at, left_size).distinct().select(own.alias("__l"), F.col(key).alias("__k"), micros(left_at).alias("__at"), cell(left_size).alias("__c"))
    rights = able(right, right_at, right_size).select(F.col(key).alias("__k"), cell(right_size).alias("__cell"), micros(right_at).alias("__at"), F.col(right_size).alias("__size"), F.col(pick).alias("__pick"))

    asked = lambda offsets: lefts.withColumn("__cell", F.explode(F.transform(F.lit(offsets), lambda d: d + F.col("__c"))))
    given = rights.groupBy("__k", "__cell", "__at").agg(F.min("__pick").alias("__pick"))
    given = given.select("__k", "__cell", "__at", F.struct("__at", "__pick").alias("__r"))
    near = _neighbours(asked([-1, 0, 1]).drop("__c").unionByName(given, allowMissingColumns=True), ["__k", "__cell"], width)
    found = lambda r: F.when(F.col(r).isNotNull(), F.struct(F.abs(F.col("__at") - F.col(f"{r}.__at")).alias("gap"), F.col(f"{r}.__pick").alias("pick")))
    inner = near.groupBy("__l").agg(F.min(F.least(found("before"), found("after"))).alias("m"))

    reach = F.expr("m.gap")
    moment = F.unix_micros(F.col(f"__l.{left_at}").cast("timestamp"))
    spans = inner.select("__l", F.col(f"__l.{key}").alias("__k"), F.coalesce(F.timestamp_micros(moment - reach - 1), F.lit("0001-01-01").cast("timestamp")).alias("__begin"), F.timestamp_micros(moment + reach).alias("__end"), F.log(F.col(f"__l.{left_size}")).alias("__log"))
    spans = spans.withColumn("__cell", F.explode(F.transform(F.lit([-3, -2, 2, 3]), lambda d: d + F.floor(F.col("__log") / F.log(F.lit(ratio)) * 3)))).drop("__log")
    outer = within_interval(rights.withColumn("__when", F.timestamp_micros("__at")).drop("__at"), spans, ["__k", "__cell"], "__when", "__begin", "__end")
    size = F.col(f"__l.{left_size}")
    outer = outer.where((F.col("__size") > size * F.lit(1 / ratio)) & (F.col("__size") < size * F.lit(ratio)))
    outer = outer.select("__l", F.struct(F.abs(moment - F.unix_micros("__when")).alias("gap"), F.col("__pick").alias("pick")).alias("m"))

    best = inner.unionByName(outer).groupBy("__l").agg(F.min("m").alias("m")).where("m IS NOT NULL")
    return best.select(*[F.col(f"__l.`{c}`").alias(c) for c in left.columns], F.col("m.pick").alias(pick), F.col("m.gap").alias("gap"))


def field_profile(df: DataFrame) -> DataFrame:
    """(field, filled, rows, percent, longest) of every column in one pass: how often it holds something."""
    text = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns}
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.struct(F.lit(c).alias("field"), F.count_if(t != "").alias("filled"), F.max(F.length(t)).alias("longest")).alias(f"f{k}") for k, (c, t) in enumerate(text.items())])
    each = row.select("rows", F.explode(F.array(*[F.col(f"f{k}") for k in range(len(text))])).alias("f"))
    return each.select("f.field", "f.filled", "rows", F.round(F.lit(100.0) * F.col("f.filled") / F.col("rows"), 2).alias("percent"), "f.longest")
