"""Containment search of short test items in long documents.

Items are grouped by size (powers of two of their shingles). For each group, documents are cut into windows
of shingles that overlap by half and are twice as long as the group's longest item, so a long item changes
nothing for the others; windows at the end of documents are shorter and are partitioned by size as well. The
containment wanted of an item turns into a Jaccard similarity with a window of the partition's upper size,
and that into the number of single-value MinHash bands which misses an item with a probability of at most
``MISS``: 50 at most, whatever the sizes. An item whose minimum under one hash function equals a window's is
a candidate in that document, and the exact share of the item's shingles in the whole document decides. Items
with so few shingles that sketches would need more bands than they have shingles to offer are looked up by
every shingle instead, which is the same test with no chance of a miss.

Items are taken in blocks of ``BLOCK`` different ones (a bound for what is broadcast); each block reads the
documents once, so the number of items has no limit and documents are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, utf8
from tidemark.llm.shingles import grams, mix, sets, shingle_sets, words

THRESHOLD = 0.75
MISS = 1e-4
BLOCK = 20_000
#: Items with fewer shingles than this are looked up by each of them.
SMALL = 12


class Group:
    """Sketches of the items of one range of sizes."""

    def __init__(self, which: np.ndarray, size: np.ndarray, sets_: list[np.ndarray], threshold: float):
        least, self.half = int(size[which].min()), int(size[which].max())
        self.least = math.ceil(threshold * least - 1e-9)
        #: (longer than, up to, bands) of the partitions of windows; shorter ones hold no item of the group.
        self.windows: list[tuple[int, int, int]] = []
        low, limit = 0, 16
        while low < 2 * self.half:
            up = min(limit, 2 * self.half)
            if up >= self.least:
                jaccard = threshold * least / (up + least - threshold * least)
                self.windows.append((low, up, math.ceil(math.log(MISS) / math.log(1 - min(jaccard, 0.999)))))
            low, limit = up, 2 * limit
        number = max(bands for _, _, bands in self.windows)
        self.seeds = mix(np.arange(1, number + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.sketch = [Items._index(np.array([_hash(sets_[i], s).min() for i in which], np.uint64), which) for s in self.seeds]


class Items:
    """Sketches of a block of items; ``copies`` tells how often each stands in its table."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float, copies: list[int] | None = None):
        data, offsets = utf8(pa.array(texts, pa.string()))
        value, start = shingle_sets(data, offsets)
        size = np.diff(start)
        self.ids, self.size, self.copies = ids, size, copies or [1] * len(ids)
        self.sets = [value[a:b] for a, b in zip(start[:-1], start[1:], strict=True)]
        self.need = np.array([math.ceil(threshold * int(n) - 1e-9) for n in size], np.int64)
        small = np.flatnonzero((size > 0) & (size < SMALL))
        self.direct = self._index(np.concatenate([self.sets[i] for i in small]), np.repeat(small, size[small])) if len(small) else None
        power = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
        self.groups = [Group(which, size, self.sets, threshold) for g in np.unique(power) if len(which := np.flatnonzero((power == g) & (size >= SMALL)))]

    @staticmethod
    def _index(value: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(value, kind="stable")
        return value[order], item[order]


def _hash(value: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = value * seed
    return x ^ (x >> np.uint64(31))


def _hits(index: tuple[np.ndarray, np.ndarray], value: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """(row, item) of each value found."""
    known, item = index
    a = np.searchsorted(known, value, side="left")
    some = np.flatnonzero(known[np.minimum(a, len(known) - 1)] == value)
    if not len(some):
        return []
    a, b = a[some], np.searchsorted(known, value[some], side="right")
    return [np.stack([np.repeat(row[some], b - a), np.concatenate([item[x:y] for x, y in zip(a, b, strict=True)])], 1)]


def _in_windows(group: Group, value: np.ndarray, row: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """(row, item) candidates of a group's items; ``n``: shingles of each row."""
    begin = np.cumsum(n) - n
    half = group.half
    blocks = np.where(n >= group.least, -(-n // half), 0)
    of = np.repeat(np.arange(len(n)), blocks)
    if not len(of):
        return []
    k = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = begin[of] + k * half
    length = np.minimum(2 * half, n[of] - k * half)
    end = first + length
    # A half begins where a window does; one more stop for each row keeps what follows it apart.
    stops = np.unique(np.concatenate([first, np.minimum(first + half, end), end]))
    stops = stops[stops < len(value)]
    at = np.searchsorted(stops, first)
    more = (length > half) & (at + 1 < len(stops))
    pairs = []
    for low, up, bands in group.windows:
        some = np.flatnonzero((length > low) & (length <= up))
        if not len(some):
            continue
        few = len(some) < len(of) // 4
        if few:
            size = length[some]
            begins = np.cumsum(size) - size
            gathered = value[np.repeat(first[some] - begins, size) + np.arange(size.sum())]
        for seed, index in zip(group.seeds[:bands], group.sketch[:bands], strict=True):
            if few:
                least = np.minimum.reduceat(_hash(gathered, seed), begins)
            else:
                own = np.minimum.reduceat(_hash(value, seed), stops)
                following = own[np.minimum(at + 1, len(own) - 1)]
                least = np.where(more, np.minimum(own[at], following), own[at])[some]
            pairs += _hits(index, least, of[some])
    return pairs


def _search(items: Items, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, item, shingles shared) of all items contained in the rows."""
    rows = len(offsets) - 1
    value, row = grams(*words(data, offsets), rows)
    if not len(value):
        return []
    pairs = _hits(items.direct, value, row) if items.direct else []
    n = np.bincount(row, minlength=rows)
    for group in items.groups:
        pairs += _in_windows(group, value, row, n)
    if not pairs:
        return []
    pairs = np.unique(np.concatenate(pairs), axis=0)
    distinct, start = sets(value, row, rows)
    found = []
    for r, i in pairs.tolist():
        own = distinct[start[r] : start[r + 1]]
        at = np.searchsorted(own, items.sets[i])
        shared = int((own[np.minimum(at, len(own) - 1)] == items.sets[i]).sum())
        if shared >= items.need[i]:
            found += [(r, i, shared)] * items.copies[i]
    return found


def _blocks(items: DataFrame, item_col: str, text_col: str, threshold: float) -> Iterator[Items]:
    """Rows that repeat are one item with a number of copies, so a block of different ones is bounded."""
    own = items.groupBy(F.col(item_col).alias("item"), F.col(text_col).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    parts = max(1, -(-own.count() // BLOCK))
    for k in range(parts):
        rows = own.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).collect()
        if rows:
            yield Items([r[0] for r in rows], [r[1] for r in rows], threshold, [r[2] for r in rows])


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (id, item, item_shingles, shared, containment): the items of which a document holds at least
    ``threshold`` of the distinct shingles, in its whole text.

    Null and empty texts hold nothing and are held by nothing. Each row of either table stands alone: repeated rows
    give repeated results. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` {items.schema[item_col].dataType.simpleString()}, item_shingles long, shared long, containment double"
    out = None
    for block in _blocks(items, item_col, text_col, threshold):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            its = sent.value
            kind = pa.array(its.ids).type
            for batch in batches:
                for part in slices(batch, text_col):
                    found = _search(its, *utf8(part.column(1)))
                    if found:
                        size = [int(its.size[i]) for _, i, _ in found]
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column(0).take(pa.array([r for r, _, _ in found], pa.int64())),
                                pa.array([its.ids[i] for _, i, _ in found], kind),
                                pa.array(size, pa.int64()),
                                pa.array([s for _, _, s in found], pa.int64()),
                                pa.array([s / n for (_, _, s), n in zip(found, size, strict=True)], pa.float64()),
                            ],
                            names=[id_col, item_col, "item_shingles", "shared", "containment"],
                        )

        part = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def without_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no item.

    Null and empty texts hold nothing and stay; repeated rows all stay or all go; columns may have any names;
    without documents the result is empty, without items it is all documents.
    """
    spark = docs.sparkSession
    out = docs
    for block in _blocks(items, item_col, text_col, threshold):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col):
                    keep = np.ones(part.num_rows, bool)
                    column = part.column(part.schema.get_field_index(text_col))
                    keep[[r for r, _, _ in _search(sent.value, *utf8(column))]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
