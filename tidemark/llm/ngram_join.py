"""Jaccard self-join of word-shingle sets by T-occurrence search (DivideSkip).

Two documents link when their shingle sets have a Jaccard similarity of at least 3/4. Documents with equal
sets form a class, and classes are joined. A set of n shingles needs an overlap of T = ceil(3n/4) with any
partner. Each set is a query, and its inverted lists are divided into those that are merged and those that
are probed. All sets take their shingles in one order: those of short lists first, by hash, those of long
lists last. The first n - T + 1 + ``EXTRA`` are merged, the other T - 1 - ``EXTRA`` are probed.

* Counting: all shingles of all texts are counted. Lists longer than ``SHORT`` are long; if there are more
  than ``LONG_LISTS`` of them, the limit rises until there are not, which bounds what is sent to executors.
* Merging: postings are dealt by shingle, which gives the short lists, and each list goes to its members,
  dealt by query. There a heap merges the lists of a query; where fewer lists than required stand at the top,
  others are advanced by binary search (MergeSkip). A partner must occur at least as often as the smaller of
  both sets' T less the lists that it doesn't merge (their slack, 1 + ``EXTRA`` unless long lists cut it).
* Probing: for each candidate the query's shingles are looked up in the partner's sorted set by binary
  search, which tells in which lists the partner stands without reading these lists. The exact overlap
  decides. Sets are made once for each class that is a candidate, from whole texts.
* Long lists are never merged. A set with so many long shingles that they alone can reach T is kept with its
  long shingles. Sets with equal long shingles and sizes behave alike and count once. The others that share
  one of their first long shingles are compared with the list's hub, again by binary search; members that a
  hub doesn't connect get further hubs, and what then still lies in different components of one list is
  compared pair by pair. Long lists are split into parts of ``PART`` members, so none lands in one task.

Hashes travel packed in binary blocks. No step brings links, components or documents to the driver.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, slices, utf8
from tidemark.llm.components import components
from tidemark.llm.shingles import digests, mix, shingle_sets

#: Classes in a short list at least; long lists at most.
SHORT, LONG_LISTS = 32, 1 << 22
#: Keys that a task holds before it writes blocks.
HELD = 1 << 19
#: Bytes of text that a task turns into shingles at once.
SLICE = 1 << 20
HUBS = 2
#: Lists that are merged beyond the fewest that can show every partner: a partner then occurs at least 1 + EXTRA times.
EXTRA = 2
#: Members of a long list that one row of the list's hub meets.
PART = 256


def _least(n):
    """T: the overlap that a set of n shingles needs with any partner."""
    return (3 * n + 3) // 4


def _blocks(total: int) -> int:
    """Number of blocks: some 400,000 shingles each, more where that makes over 4096 blocks, up to 4 million."""
    return max(64, min(total // 400_000, 4096), total // 4_000_000)


def _sets(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shingles, sizes, class ids) of the sets that this task has not met before; empty sets are left out."""
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, text_col, SLICE):
            value, start = shingle_sets(*utf8(part.column(part.schema.get_field_index(text_col))))
            cls = digests(value, start).view(np.int64)
            n = np.diff(start)
            new = np.zeros(len(n), bool)
            for k, c in enumerate(cls.tolist()):
                if n[k] and c not in seen:
                    seen.add(c)
                    new[k] = True
            yield value[np.repeat(new, n)], n[new], cls[new]


def _deal(key: np.ndarray, blocks: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (block, packed columns) for 64-bit keys; the first packed column is the low half of the key."""
    block = ((key >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block = block[order]
    columns = [(key & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], *[c[order] for c in columns]]
    there, start = np.unique(block, return_index=True)
    end = np.append(start[1:], len(block))
    yield pa.RecordBatch.from_arrays(
        [pa.array(there.astype(np.int32)), *[pa.array([c[a:b].tobytes() for a, b in zip(start, end, strict=True)], pa.binary()) for c in columns]],
        names=["block", *[f"c{k}" for k in range(len(columns))]],
    )


def _packed(table: pa.Table, types: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(f"c{k}").to_pylist()), t) for k, t in enumerate(types)]


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _has_words(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, text_hash, class_id) of each row; rows of one class have equal shingle sets, 0 is the empty one."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                value, start = shingle_sets(*utf8(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(start)), part.column(2), pa.array(digests(value, start).view(np.int64))], names=[id_col, "n_shingles", "text_hash", "class_id"])

    return docs.select(id_col, F.col(text_col).alias("text"), _text_hash(text_col).alias("text_hash")).mapInArrow(run, f"`{id_col}` {kind}, n_shingles long, text_hash long, class_id long")


def long_lists(docs: DataFrame, text_col: str, blocks: int) -> np.ndarray:
    """Sorted shingles of the long lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, times = np.unique(np.concatenate(held), return_counts=True)
            yield from _deal(key, blocks, [times.astype(np.uint32)])

        for value, _, _ in _sets(batches, text_col):
            held.append(value)
            n += len(value)
            if n > HELD:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def merge(table: pa.Table) -> pa.Table:
        key, times = _packed(table, ["u4", "u4"])
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.add.reduceat(times.astype(np.int64), first)
        some = total > SHORT
        high = table.column("block")[0].as_py()
        return pa.table({"block": pa.array(np.full(some.sum(), high, np.int32)), "low": pa.array(key[first][some].astype(np.int64)), "times": pa.array(total[some])})

    counts = docs.select(text_col).mapInArrow(run, "block int, c0 binary, c1 binary")
    lists = checkpoint(counts.groupBy("block").applyInArrow(merge, "block int, low long, times long"))
    limit = SHORT
    while lists.where(F.col("times") > limit).count() > LONG_LISTS:
        limit *= 2
    found = lists.where(F.col("times") > limit).select("block", "low").toPandas()
    return np.sort((found["block"].to_numpy(np.uint64) << np.uint64(32)) | found["low"].to_numpy(np.uint64))


def _is_long(value: np.ndarray, long: np.ndarray, blocks: int) -> np.ndarray:
    if not len(long):
        return np.zeros(len(value), bool)
    key = (((value >> np.uint64(32)) % np.uint64(blocks)) << np.uint64(32)) | (value & np.uint64(0xFFFFFFFF))
    return long[np.minimum(np.searchsorted(long, key), len(long) - 1)] == key


def occurrences(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(value, lists that hold it) of the values that stand in at least ``least`` of the ascending lists."""
    heap = [(one[0], k) for k, one in enumerate(lists) if one]
    heapify(heap)
    at = [0] * len(lists)
    out = []
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heappop(heap)[1])
        if len(popped) >= least:
            out.append((top, len(popped)))
            to = top + 1
        else:
            # No value before the one that is then on top can be in enough lists.
            while len(popped) < least - 1:
                popped.append(heappop(heap)[1])
            to = heap[0][0] if heap else None
            if to is None:
                break
        for k in popped:
            one = lists[k]
            at[k] = bisect_left(one, to, at[k])
            if at[k] < len(one):
                heappush(heap, (one[at[k]], k))
    return out


def candidates(docs: DataFrame, text_col: str, blocks: int, sent) -> DataFrame:
    """(a, b) classes, a < b, that occur together in merged lists often enough."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, cls, n, slack = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from _deal(key, blocks, [cls, n, slack])

        for value, n, cls in _sets(batches, text_col):
            row = np.repeat(np.arange(len(n)), n)
            short = ~_is_long(value, sent.value, blocks)
            before = np.cumsum(short) - short
            begin = np.cumsum(n) - n
            rank = before - (before[begin] if len(begin) else before)[row]
            merged = np.minimum(n - _least(n) + 1 + EXTRA, np.bincount(row[short], minlength=len(n)))
            posted = short & (rank < merged[row])
            row = row[posted]
            slack = np.clip(_least(n) - (n - merged), 0, 255).astype(np.uint8)
            held.append((value[posted], cls[row], n[row].astype(np.uint32), slack[row]))
            size += len(row)
            if size > HELD:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def lists(table: pa.Table) -> pa.Table:
        """The part of each list that follows a member, for the member as query; packed by bucket of the query."""
        key, cls, n, slack = _packed(table, ["u4", "i8", "u4", "u1"])
        order = np.lexsort((cls, key))
        key, cls, n, slack = key[order], cls[order], n[order], slack[order]
        new = np.append(True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]))
        key, cls, n, slack = key[new], cls[new], n[new], slack[new]
        left, right, at, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(key)), 0
        while len(at):
            step += 1
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            close = at[4 * np.minimum(n[at], n[at + step]).astype(np.int64) >= 3 * np.maximum(n[at], n[at + step]).astype(np.int64)]
            left.append(close), right.append(close + step)
        left, right = np.concatenate(left), np.concatenate(right)
        bucket = (mix(cls[left].astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)
        order = np.lexsort((right, left, bucket))
        left, right, bucket = left[order], right[order], bucket[order]
        first = np.flatnonzero(np.append(True, left[1:] != left[:-1]))[: len(left)]
        size = np.diff(np.append(first, len(left)))
        there, start = np.unique(bucket[first], return_index=True)
        stop = np.append(start[1:], len(first)) if len(first) else start
        query, flat = left[first], np.append(first, len(left))
        rows = [(slice(a, b), slice(flat[a], flat[b])) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        columns = {"c0": (0, cls[query]), "c1": (0, slack[query]), "c2": (0, size.astype(np.uint32)), "c3": (1, cls[right]), "c4": (1, slack[right])}
        packed = {name: pa.array([x[row[which]].tobytes() for row in rows], pa.binary()) for name, (which, x) in columns.items()}
        return pa.table({"bucket": pa.array(there.astype(np.int32)), **packed})

    def merge(table: pa.Table) -> pa.Table:
        query, own_slack, size, cls, slack = _packed(table, ["i8", "u1", "u4", "i8", "u1"])
        end = np.cumsum(size)
        order = np.argsort(query, kind="stable")
        new = np.flatnonzero(np.append(True, query[order][1:] != query[order][:-1]))[: len(query)]
        members, slacks = cls.tolist(), slack.tolist()
        begin, end = (end - size).tolist(), end.tolist()
        a, b = [], []
        for x, y in zip(new.tolist(), np.append(new[1:], len(order)).tolist(), strict=True):
            own = order[x:y].tolist()
            needs, least = {}, int(own_slack[own[0]])
            for k in own:
                needs.update(zip(members[begin[k] : end[k]], slacks[begin[k] : end[k]], strict=True))
            lowest = max(min(least, min(needs.values())), 1)
            for c, times in occurrences([members[begin[k] : end[k]] for k in own], lowest):
                if times >= min(least, needs[c]):
                    a.append(int(query[own[0]])), b.append(c)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    posts = docs.select(text_col).mapInArrow(post, "block int, c0 binary, c1 binary, c2 binary, c3 binary")
    sent_on = posts.groupBy("block").applyInArrow(lists, "bucket int, " + ", ".join(f"c{k} binary" for k in range(5)))
    return sent_on.groupBy("bucket").applyInArrow(merge, "a long, b long")


def _probe(a: np.ndarray, b: np.ndarray) -> int:
    """Members of the smaller sorted set that binary search finds in the larger."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) else 0


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (a, b, na, sa, nb, sb) whose sorted, packed sets share enough."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):  # sets may be large, so few at a time
            part = batch.slice(k, 256)
            na, nb = np.asarray(part.column(2)), np.asarray(part.column(4))
            both = np.array([_probe(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(part.column(3), part.column(5), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(7 * both >= 3 * (na + nb)))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that link by their ``sets`` (id, n, packed)."""
    left, right = (sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("packed").alias(f"s{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(_linked, "a long, b long")


def sets_of(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, packed) of the classes in ``pairs``, once each. ``classes``: (class_id, rep)."""
    inside = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    texts = classes.join(inside, "class_id").join(docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")), "rep").select("class_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                value, start = shingle_sets(*utf8(part.column(1)))
                own = digests(value, start).view(np.int64) == np.asarray(part.column(0))  # rows that share an id may differ
                packed = [value[x:y].tobytes() for x, y in zip(start[:-1], start[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(start)), pa.array(packed, pa.binary())], names=["id", "n", "packed"]).filter(pa.array(own))

    found = texts.mapInArrow(run, "id long, n long, packed binary")
    return checkpoint(found.groupBy("id").agg(F.first("n").alias("n"), F.first("packed").alias("packed")))


def long_links(docs: DataFrame, text_col: str, blocks: int, sent) -> DataFrame | None:
    """(a, b) classes that link through long lists alone, enough of them to connect what so links; None without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, n, cls in _sets(batches, text_col):
            long = _is_long(value, sent.value, blocks)
            row = np.repeat(np.arange(len(n)), n)
            many = np.bincount(row[long], minlength=len(n))
            keep = many >= _least(n)
            value, row = value[long & keep[row]], row[long & keep[row]]
            size = np.bincount(row, minlength=len(n))[keep]
            start = np.append(0, np.cumsum(size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls[keep]), pa.array(n[keep].astype(np.int64)), pa.array(digests(value, start).view(np.int64)), pa.array([value[a:b].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)], pa.binary())],
                names=["class_id", "n", "signature", "longs"],
            )

    sets = docs.select(text_col).mapInArrow(run, "class_id long, n long, signature long, longs binary")
    sets = checkpoint(sets.groupBy("class_id").agg(F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("longs").alias("longs")))
    alike = sets.groupBy("signature", "n").agg(F.min("class_id").alias("id"), F.first("longs").alias("longs"))
    alike = checkpoint(alike)
    size = F.length("longs") / 8
    if alike.isEmpty():
        return None

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column(1))
            longs = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            many = np.array([len(x) for x in longs], np.int64)
            longs = [x[: max(len(x) - int(t) + 1, 0)] for x, t in zip(longs, _least(n), strict=True)]
            size = np.array([len(x) for x in longs], np.int64)
            row = np.repeat(np.arange(len(n)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(longs)), batch.column(0).take(pa.array(row)), pa.array(n[row]), pa.array(many[row] - place)], names=["shingle", "id", "n", "left"])

    posts = alike.select("id", "n", "longs").mapInArrow(first, "shingle long, id long, n long, left long")

    whole = alike.select("id", "n", F.col("longs").alias("packed"))

    # From the first shingle that two sets share on, both must have enough left to reach the overlap that both need.
    able = F.least("la", "lb") * 7 >= (F.col("na") + F.col("nb")) * 3
    edges = None
    for turn in range(HUBS + 1):
        if turn:
            comp = components(edges)
            placed = posts.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
            open_ = placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
            # Written first, so that the join reads plain exchanges, of which adaptive execution splits a long list.
            lists = checkpoint(placed.join(checkpoint(open_), "shingle"))
            if lists.isEmpty():
                break
        else:
            lists = posts.withColumn("component", F.col("id"))
        # The first hub is the set with fewest short shingles: what others were made from, if it is there.
        rank = F.struct((F.xxhash64("id", F.lit(turn)) if turn else F.col("n") - F.col("left")).alias("rank"), "id", "n", "left", "component")
        hubs = checkpoint(lists.groupBy("shingle").agg(F.min(rank).alias("h"), F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")))
        parts = hubs.select("shingle", "parts")
        if turn < HUBS:
            left = hubs.select("shingle", F.col("h.id").alias("a"), F.col("h.n").alias("na"), F.col("h.left").alias("la"), F.col("h.component").alias("ca"), "parts")
        else:
            left = lists.join(parts, "shingle").select("shingle", F.col("id").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("component").alias("ca"), "parts")
        # A row of the left meets each part of the list; members are dealt over the parts, of which a short list has one.
        left = left.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        right = lists.join(parts, "shingle").select(
            "shingle", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"), F.col("component").alias("cb")
        )
        pairs = left.join(right, ["shingle", "part"]).where("ca <> cb").where(able)
        pairs = (pairs if turn < HUBS else pairs.where("a < b")).select("a", "b").distinct()
        new = checkpoint(linked(pairs, whole))
        edges = new if edges is None else edges.unionByName(new)
    # Sets that are alike link among themselves if their long shingles suffice, or if they link to another kind, which all of them do.
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("linked", F.lit(True))
    bound = alike.select("signature", "n", "id", size.alias("size")).join(ends, "id", "left").where((F.col("size") * 7 >= F.col("n") * 6) | F.col("linked"))
    members = sets.select("class_id", "signature", "n").join(bound, ["signature", "n"]).where("class_id <> id")
    return edges.unionByName(members.select(F.col("id").alias("a"), F.col("class_id").alias("b")))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, text_hash, class_id, component, component_id) of each row; ``text_hash`` tells rows that share an id apart, ``component`` components."""
    sc = docs.sparkSession.sparkContext
    rows = checkpoint(profile(docs, id_col, text_col))
    classes = rows.where((F.col("n_shingles") > 0) & F.col(id_col).isNotNull()).groupBy("class_id").agg(F.min(id_col).alias("rep"))
    classes = checkpoint(classes)
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    known = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    blocks = _blocks(total)
    sent = sc.broadcast(long_lists(known, text_col, blocks))
    pairs = checkpoint(candidates(known, text_col, blocks, sent))
    edges = linked(pairs, sets_of(pairs, known, classes, id_col, text_col))
    if len(sent.value):
        long = long_links(known, text_col, blocks, sent)
        edges = edges if long is None else edges.unionByName(long)
    comp = components(edges).withColumnRenamed("id", "class_id")
    placed = classes.join(comp, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    # Written first, so that the join reads plain exchanges, of which adaptive execution splits a large component.
    found = placed.join(checkpoint(least), "component").select("class_id", "component", "component_id")
    out = rows.join(found, "class_id", "left")
    own = F.when(F.col(id_col).isNull(), F.lit(None)).otherwise(F.coalesce("component_id", id_col))
    return out.withColumn("component_id", own)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Empty and null texts have no shingles and link with nothing. Rows with a null id are profiled but not
    linked; their component is null. Repeated rows and copies are in one component. Other columns are not
    read; an empty table gives an empty result.
    """
    return _grouped(docs, id_col, text_col).select(id_col, "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that stay when each component keeps one row of the document with
    its smallest id.

    Of rows with that id in the component, those of one text count (the least by hash), and of those that also
    share the text any one. Rows without an id or without words all stay. Columns may have any name; an empty
    table gives an empty result.
    """
    found = _grouped(docs, id_col, text_col).where((F.col("n_shingles") > 0) & (F.col(id_col) == F.col("component_id")))
    keep = found.groupBy("component", F.col(id_col).alias("id"), "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    keep = keep.groupBy("component").agg(F.min(F.struct("id", "text_hash", "copies")).alias("k")).select("k.*")
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), _text_hash(text_col).alias("text_hash"), _has_words(text_col).alias("words"))
    loose = F.col("id").isNull() | ~F.col("words")
    keep = checkpoint(keep)
    rows = whole.where(~loose).join(keep.where("copies = 1"), ["id", "text_hash"]).select("row").unionByName(whole.where(loose).select("row"))
    repeated = keep.where("copies > 1")
    if not repeated.isEmpty():
        again = whole.where(~loose).join(repeated, ["id", "text_hash"]).groupBy("id", "text_hash").agg(F.any_value("row").alias("row"))
        rows = rows.unionByName(again.select("row"))
    return rows.select("row.*")
