"""Filter interaction audit: what each order of filters removes, from sorted posting lists.

Documents are laid out by id in ranges of about ``RANGE`` rows. For each part of a range, every filter keeps the
ascending list of the documents that fail it, and labels keep lists of their own. Lists hold places in the range's
ids (``ids``), so that rows which repeat an id stay apart. A k-way merge by galloping makes the union of the lists of
each set of filters; the difference of one more filter's list and that union is what this filter removes when it
follows the set. Only sizes leave a range, and sums over ranges give every part's figures for all orders.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint

RANGE = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


#: Conditions under which a text fails; the filter of copies is ``COPY`` and looks at all texts.
FILTERS = {
    "A": lambda text: F.size(_words(text)) < 100,
    "B": lambda text: F.size(F.array_distinct(_words(text))) * 100 < F.size(_words(text)) * 80,
    "C": lambda text: F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 10,
    "D": lambda text: text.rlike(r"[#$%&*|]"),
}
COPY = "E"


def gallop(values: list[int], x: int, at: int) -> int:
    """The first place from ``at`` whose value is ``x`` or more: steps that double, then binary search between the last two."""
    step = 1
    while at + step <= len(values) and values[at + step - 1] < x:
        at += step
        step *= 2
    return bisect_left(values, x, at, min(at + step, len(values)))


def union(lists: list[list[int]]) -> list[int]:
    """The values of ascending lists, once each: a k-way merge that takes whole runs of the list that is behind."""
    lists = [x for x in lists if x]
    at, out = [0] * len(lists), []
    while len(lists) > 1:
        heads = sorted((x[a], k) for k, (x, a) in enumerate(zip(lists, at, strict=True)))
        (low, k), (bound, _) = heads[0], heads[1]
        if low == bound:  # stands in both; the other list gives it
            at[k] += 1
        else:
            to = gallop(lists[k], bound, at[k])
            out += lists[k][at[k] : to]
            at[k] = to
        if at[k] == len(lists[k]):
            del lists[k], at[k]
    return out + lists[0][at[0] :] if lists else out


def difference(a: list[int], b: list[int]) -> list[int]:
    """The values of ``a`` that are not in ``b``, both ascending."""
    out, i, j = [], 0, 0
    while i < len(a):
        j = gallop(b, a[i], j)
        if j == len(b):
            return out + a[i:]
        if b[j] == a[i]:
            i += 1
        else:
            to = gallop(a, b[j], i)
            out += a[i:to]
            i = to
    return out


def failing(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(part, id, good, toxic, a flag for each filter) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    flags = [f(text).alias(name) for name, f in FILTERS.items()]
    same = F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("same")
    rows = checkpoint(docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).alias("id"), *flags, same))
    first = rows.groupBy("same").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("same", "first")
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    # Written first, so that the joins read plain exchanges, of which adaptive execution splits a text that many rows share.
    rows = checkpoint(rows.join(checkpoint(first), "same", "left").withColumn(COPY, F.coalesce(F.col("id") > F.col("first"), F.lit(False))))
    rows = rows.join(marks, "id", "left")
    return rows.select("part", "id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], *FILTERS, COPY)


def posting_lists(rows: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    """(part, ids, good, toxic, a list for each filter): one row for each part in each range of ids.

    ``rows``: part, id, good, toxic and a flag for each filter. Lists are ascending places in ``ids``.
    """
    rows = checkpoint(rows)
    lists = ("good", "toxic", *filters)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        part = np.asarray(table.column(0).to_pandas().factorize()[0])
        for k in np.unique(part):  # rows of a part are in the order of their ids
            own = table.take(pa.array(np.flatnonzero(part == k)))
            columns = [own.column(0).slice(0, 1).combine_chunks(), pa.array([own.column(1).to_pylist()], pa.list_(own.schema.field(1).type))]
            columns += [pa.array([np.flatnonzero(np.asarray(own.column(c))).astype(np.int32)], pa.list_(pa.int32())) for c in lists]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "ids", *lists])

    numbered = rows.withColumn("row", F.monotonically_increasing_id())  # of a written table, so the same whenever it is read
    ranges = numbered.repartitionByRange(max(1, -(-rows.count() // RANGE)), "id", "row").sortWithinPartitions("id", "row")
    return ranges.select("part", "id", *lists).mapInArrow(run, f"part string, ids array<{kind}>, " + ", ".join(f"`{c}` array<int>" for c in lists))


def set_sizes(lists: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    """(part, prefix, filter, removed, good, toxic): what a filter removes behind the set of filters ``prefix``, of all rows and of labelled ones.

    ``prefix`` is the sorted names of the set. Rows with an empty ``filter`` have the rows that the set leaves as ``removed``.
    """
    subsets = [s for k in range(len(filters) + 1) for s in combinations(sorted(filters), k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                out = []
                for s in subsets:
                    gone = union([row[f] for f in s])
                    out.append(("".join(s), "", len(row["ids"]) - len(gone), 0, 0))
                    for f in filters:
                        if f not in s:
                            removed = difference(row[f], gone)
                            out.append(("".join(s), f, len(removed), *[len(row[c]) - len(difference(row[c], removed)) for c in ("good", "toxic")]))
                yield pa.RecordBatch.from_pydict({"part": [row["part"]] * len(out)} | {name: [x[i] for x in out] for i, name in enumerate(("prefix", "filter", "removed", "good", "toxic"))})

    found = lists.mapInArrow(run, "part string, prefix string, filter string, removed long, good long, toxic long")
    return found.groupBy("part", "prefix", "filter").agg(*[F.sum(c).alias(c) for c in ("removed", "good", "toxic")])


def orders(sizes: DataFrame, filters: tuple[str, ...]) -> DataFrame:
    """The figures of every order and step, from the sizes of all sets."""
    steps = [("".join(p), k + 1, p[k], "".join(sorted(p[:k])), "".join(sorted(p[: k + 1]))) for p in permutations(filters) for k in range(len(filters))]
    table = F.broadcast(sizes.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, prefix string, after string"))
    removals = sizes.where("filter <> ''")
    others = F.length("prefix") == len(filters) - 1
    times = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(filters) - 1 - k)) for k in range(len(filters))]), F.length("prefix") + 1)
    whole = removals.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("prefix") == "", F.col("removed"))).alias("fails"), F.sum(F.when(others, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * times).alias("shapley")
    )
    left = sizes.where("filter = ''").select("part", F.col("prefix").alias("after"), F.col("removed").alias("kept"))
    rows = removals.join(table, ["prefix", "filter"]).join(whole, ["part", "filter"]).join(left, ["part", "after"])
    return rows.select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the five filters and step.

    Null texts count as empty, null parts as the empty string. Every row is a document of its own, rows that repeat as
    well; it is a copy if a smaller id has its text, so rows with a null id are no copies and have no labels. A document
    with several labels is good, or toxic, if one of them says so. Tables without documents give no rows; other
    columns are not read. Range sizes are even whatever the ids, and no task holds more than a range.
    """
    filters = (*FILTERS, COPY)
    sizes = checkpoint(set_sizes(posting_lists(failing(docs, labels, id_col, text_col, part_col), filters), filters))
    return orders(sizes, filters)
