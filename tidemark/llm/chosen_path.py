"""Near-duplicate removal by a chosen-path set similarity join.

Documents with equal shingle sets form a class. A class has a sketch: its smallest member under each of
``COORDINATES`` hash functions, of which 16 bits are kept. A tree branches the classes recursively: a node draws
one coordinate, or two with the chance that makes 1/threshold on average, and each class goes to the child of its
value there. A pair at the threshold then goes on together along one path on average, others lose each other
sooner. Every draw depends on the node alone, so a class finds its children without looking at others.

* Trees are independent; ``trees`` tells how many of them miss a pair at the threshold with less than the chance
  wanted, if it gets ``LEVELS`` levels deep. All trees advance together, one level a turn.
* Nodes of at most ``SMALL`` members are compared exhaustively, by two bits of each coordinate. They stay narrow
  (44 bytes a member), and what differs too much, or is of too different size, makes no pair. From the second level
  on this holds for nodes up to ``BLOCKED``, in blocks and on full sets: texts that are nearly similar enough don't
  part for long, and are too many to leave a task as pairs.
* In larger nodes every member is compared with the node's hub, the most central one, and the node is branched, unless its members are in
  one component already. What is still large after ``DEPTH`` levels is compared in blocks too.
* Pairs are confirmed on full sets made from whole texts: first one pair for each class, then those whose ends these
  have not connected.

Members of a node meet by a join on it. Nodes with over 1/4096 of all entries, so 4096 at most, are broadcast by
name and number, and their entries are never exchanged by node; thus no task gets more than that share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Folder, checkpoint, shuffle_partitions, slices, utf8
from tidemark.llm.components import components
from tidemark.llm.shingles import digests, grams, mix, sets, words

WIDTH, PERCENT = 3, 85
COORDINATES, LEVELS, DEPTH = 64, 3, 16
RECALL = 0.99999
#: Members of a node that one row holds, of a node that is compared in blocks below the first level, and of a block.
SMALL, BLOCKED, PART = 48, 4096, 512
#: Shingles in one matrix of a block.
COLUMNS = 4096
#: Standard deviations of the differing bits that a pair at the threshold may be off.
SPREAD = 5.5
SLICE = 1 << 20
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def survival(percent: int, levels: int) -> float:
    """Chance that a pair at the threshold is together in some node ``levels`` below the root."""
    alike, second, out = percent / 100, 100 / percent - 1, 1.0
    for _ in range(levels):
        miss = 1 - alike * out
        out = 1 - ((1 - second) * miss + second * miss**2)
    return out


def trees(percent: int = PERCENT, recall: float = RECALL) -> int:
    """Independent trees that find a pair at the threshold with the chance wanted."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(percent, LEVELS)))


def _roots(percent: int, recall: float) -> list[tuple[int, int]]:
    """(tree, coordinate) of the children of all roots; the coordinates are different while they last."""
    draw = np.random.Generator(np.random.PCG64(20240611))
    number = trees(percent, recall)
    twice = draw.random(number) < 100 / percent - 1
    order = np.resize(draw.permutation(COORDINATES), number + twice.sum())
    return list(zip([t for t in range(number) for _ in range(1 + twice[t])], order.tolist(), strict=True))


def _bits(percent: int) -> int:
    """Differing bits, of two for each coordinate, that a pair may show: at unequal minima each differs by chance."""
    miss = 1 - percent / 100
    return math.floor(COORDINATES * miss + SPREAD * math.sqrt(COORDINATES * (1.5 * miss - miss**2)))


def profile(docs: DataFrame, id_col: str, text_col: str, roots: list[tuple[int, int]]) -> DataFrame:
    """(id, n, class_id, sketch, b0, b1, roots) of each row: 16 bits and two bits of each minimum, and the nodes below the roots."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinate = np.array([c for _, c in roots])
        salt = mix(np.array([t * COORDINATES + c + 1 for t, c in roots], np.uint64) * _STEP)
        shift = np.arange(COORDINATES // 2, dtype=np.uint64) * np.uint64(2)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows = part.num_rows
                value, start = sets(*grams(*words(*utf8(part.column(1))), rows, WIDTH), rows)
                size = np.diff(start)
                some = np.flatnonzero(size)
                least = np.zeros((rows, COORDINATES), np.uint64)
                for k, seed in enumerate(_SEEDS if len(some) else ()):
                    x = value * seed
                    x ^= x >> np.uint64(31)
                    least[some, k] = np.minimum.reduceat(x, start[some])
                least = mix(least)
                low = (least & np.uint64(3)).reshape(rows, 2, -1) << shift
                pair = np.bitwise_or.reduce(low, axis=2).astype(np.uint64).view(np.int64)
                nodes = mix(least[:, coordinate] ^ salt).view(np.int64)
                sketch = (least & np.uint64(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(size), pa.array(digests(value, start).view(np.int64)), pa.array([x.tobytes() for x in sketch], pa.binary()),
                        pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.ListArray.from_arrays(np.arange(0, nodes.size + 1, nodes.shape[1], dtype=np.int32), nodes.ravel()),
                    ],
                    names=[id_col, "n", "class_id", "sketch", "b0", "b1", "roots"],
                )

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n long, class_id long, sketch binary, b0 long, b1 long, roots array<long>")


def _compared(most: int, percent: int):
    """(a, b) of rows (members): pairs of one node whose sizes and bits allow the threshold and whose components differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            ids, n, b0, b1, comp = (np.asarray(flat.field(k)) for k in range(5))
            length = np.asarray(lists.value_lengths(), np.int64)
            end = np.repeat(np.cumsum(length), length)
            at, step, a, b = np.arange(len(ids)), 0, [], []
            while len(at):
                step += 1
                at = at[at + step < end[at]]
                to = at + step
                close = (100 * np.minimum(n[at], n[to]) >= percent * np.maximum(n[at], n[to])) & (comp[at] != comp[to])
                close &= np.bitwise_count((b0[at] ^ b0[to]).view(np.uint64)).astype(np.int64) + np.bitwise_count((b1[at] ^ b1[to]).view(np.uint64)) <= most
                a.append(ids[at[close]]), b.append(ids[to[close]])
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _able(percent: int, most: int, x: str, y: str) -> Column:
    """The same test of rows that hold both members."""
    n, m = F.col(f"n{x}"), F.col(f"n{y}")
    differing = F.bit_count(F.col(f"b0{x}").bitwiseXOR(F.col(f"b0{y}"))) + F.bit_count(F.col(f"b1{x}").bitwiseXOR(F.col(f"b1{y}")))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differing <= most) & (F.col(f"component{x}") != F.col(f"component{y}"))


def _children(members: DataFrame, percent: int) -> DataFrame:
    """Each member once for each coordinate that its node draws; ``members``: node, id and sketch."""
    at = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(COORDINATES))
    twice = F.pmod(F.xxhash64("node", F.lit(0)), F.lit(1_000_000)) < round((100 / percent - 1) * 1_000_000)
    drawn = F.when(twice & (at(1) != at(2)), F.array(at(1), at(2))).otherwise(F.array(at(1)))
    value = F.hex(F.substring(F.col("sketch"), (F.col("c") * 2 + 1).cast("int"), F.lit(2)))
    return members.withColumn("c", F.explode(drawn)).withColumn("node", F.xxhash64("node", "c", value)).drop("c", "sketch")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough; the smaller one is looked up in the larger."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return (100 + percent) * both >= percent * (len(x) + len(y))


def _confirmed(percent: int):
    """(a, b) of rows (a, b, sa, sb) whose sorted, packed sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # sets may be large, so few at a time
                part = batch.slice(k, 256)
                keep = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(part.column(2), part.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _overlaps(packed: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Members that the sets ``left`` share with the sets ``right``: products of 0/1 matrices over the shingles that several sets have, some columns at a time."""
    value, column, times = np.unique(np.concatenate(packed), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(packed)), [len(x) for x in packed])
    several = times > 1
    some = several[column]
    row, column = row[some], (np.cumsum(several) - 1)[column[some]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(several.sum()), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        held = np.zeros((len(packed), COLUMNS), np.float32)
        held[row[a:b], column[a:b] - first] = 1
        both += held[left] @ held[right].T
    return both


def _linked_in_block(percent: int):
    """(a, b) of the members of one block, or across two, whose sets are similar enough: as many as connect what so links."""

    def run(table: pa.Table) -> pa.Table:
        part, ids, comp = (np.asarray(table.column(c)) for c in ("part", "id", "component"))
        packed = [np.frombuffer(x, np.uint64) for x in table.column("packed").to_pylist()]
        low, high = (table.column(c)[0].as_py() for c in ("low", "high"))
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        a, b = [], []
        if len(left) and len(right):
            n = np.array([len(x) for x in packed])
            both = _overlaps(packed, left, right).astype(np.int64)
            alike = ((100 + percent) * both >= percent * (n[left][:, None] + n[right])) & (comp[left][:, None] != comp[right])
            up = {c: c for c in comp.tolist()}

            def root(x: int) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            for i, k in zip(*np.nonzero(alike), strict=True):
                x, y = root(int(comp[left[i]])), root(int(comp[right[k]]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    a.append(int(ids[left[i]])), b.append(int(ids[right[k]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


class Join:
    """The state of a join: classes (id, rep, n, sketch, b0, b1, roots), links found, components."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, percent: int, recall: float):
        self.docs, self.id_col, self.text_col, self.percent, self.most = docs, id_col, text_col, percent, _bits(percent)
        roots = _roots(percent, recall)
        self.rows = checkpoint(profile(docs, id_col, text_col, roots))
        kept = F.first(F.struct("n", "sketch", "b0", "b1", "roots")).alias("k")
        classes = self.rows.where((F.col("n") > 0) & F.col(id_col).isNotNull()).groupBy(F.col("class_id").alias("id")).agg(F.min(id_col).alias("rep"), kept)
        self.classes = checkpoint(classes.select("id", "rep", "k.*"))
        self.repeated = not self.rows.groupBy(id_col).count().where("count > 1").isEmpty()
        self.hot = max(SMALL, self.classes.count() * len(roots) // 4096)
        self.folder = Folder(docs.sparkSession)
        self.written = self.folder.written
        self.edges: DataFrame | None = None
        self.sets: DataFrame | None = None
        self.components: DataFrame | None = None

    def run(self) -> None:
        entries = self.classes.select(F.explode("roots").alias("node"), "id", "n", "b0", "b1", F.col("id").alias("component"))
        for depth in range(DEPTH + 1):
            sizes = self.written(entries.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
            dealt, hot = self._dealt(entries, sizes)
            pairs = self._small(dealt)
            large = dealt.where(F.col("members") > SMALL).drop("members")
            large = large if hot is None else large.unionByName(hot)
            opened = None if sizes.where(F.col("members") > SMALL).isEmpty() else self._open(large)
            most = SMALL if not depth else BLOCKED if depth < DEPTH else None
            if opened is not None:
                if most is None or most > SMALL:
                    self._add(self._in_blocks(opened if most is None else opened.where(F.col("members") <= most)))
                opened = None if most is None else opened.where(F.col("members") > most)
            if opened is not None and not opened.isEmpty():
                pairs = pairs.unionByName(self._with_hubs(opened))
            if not depth:  # of all that may link here and below, so that texts are read and exchanged once
                pairs = self.written(pairs.distinct())
                ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
                self._keep_sets(ends if opened is None else ends.unionByName(opened.select("id")))
            self._link(pairs)
            opened = None if opened is None else self._open(opened)
            if opened is None:
                return
            entries = self.written(_children(opened.drop("members").join(self.classes.select("id", "sketch"), "id"), self.percent))

    def _meet(self, entries: DataFrame, nodes: DataFrame, sizes: DataFrame) -> DataFrame:
        """Entries with the columns of their nodes; ``sizes``: (node, members), of which the hot ones are 4096 at most."""
        hot = sizes.where(F.col("members") > self.hot)
        if hot.isEmpty():
            return entries.join(nodes, "node")
        names = F.broadcast(hot.select("node"))
        cold = entries.join(names, "node", "left_anti").join(nodes.join(names, "node", "left_anti"), "node")
        return cold.unionByName(entries.join(F.broadcast(nodes.join(names, "node", "left_semi")), "node"))

    def _dealt(self, entries: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Entries with their node's ``members``, in buckets of the node, so that a level exchanges them once; those of hot nodes apart, as they are."""
        hot = sizes.where(F.col("members") > self.hot).select("node")
        hot = None if hot.isEmpty() else F.broadcast(hot)
        cold = entries if hot is None else entries.join(hot, "node", "left_anti")
        dealt = cold.repartition(shuffle_partitions(self.docs.sparkSession), "node").join(sizes, "node")
        return self.folder.bucketed(dealt, "node"), None if hot is None else entries.join(hot, "node", "left_semi")

    def _small(self, dealt: DataFrame) -> DataFrame:
        small = dealt.where(F.col("members") <= SMALL)
        lists = small.groupBy("node").agg(F.collect_list(F.struct("id", "n", "b0", "b1", "component")).alias("m")).select("m")
        return lists.mapInArrow(_compared(self.most, self.percent), "a long, b long")

    def _open(self, members: DataFrame) -> DataFrame | None:
        """The members of nodes that are in several components, with their component and the node's number of ``members``."""
        known = members.drop("component")
        if self.components is not None:
            known = known.join(self.components, "id", "left").withColumn("component", F.coalesce("component", "id"))
        else:
            known = known.withColumn("component", F.col("id"))
        known = self.written(known.select("node", "id", "n", "b0", "b1", "component"))
        nodes = known.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
        nodes = self.written(nodes.where("low <> high").select("node", "members"))
        if nodes.isEmpty():
            return None
        return self.written(self._meet(known, nodes, nodes))

    def _with_hubs(self, members: DataFrame) -> DataFrame:
        """Each member with its node's hub: the one whose bits are nearest to the majority's, so what others were made from, if it is there."""
        both, nodes = ("b0", "b1"), members.select("node", "members").distinct()
        bits = members.groupBy("node").agg(F.count(F.lit(1)).alias("c"), *[F.sum(F.getbit(F.col(b), F.lit(k))).alias(f"{b}_{k}") for b in both for k in range(64)])
        more = lambda b: reduce(Column.bitwiseOR, [F.when(F.col(f"{b}_{k}") * 2 > F.col("c"), (1 << k) - (1 << 64) * (k == 63)).otherwise(0).cast("long") for k in range(64)])
        centres = self.written(bits.select("node", *[more(b).alias(f"{b}c") for b in both]))
        off = sum(F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}c"))) for b in both)
        nearest = self._meet(members, centres, nodes).groupBy("node").agg(F.min(F.struct(off.alias("off"), F.xxhash64("id").alias("r"), "id", "n", "b0", "b1", "component")).alias("hub"))
        hubs = self.written(nearest.select("node", *[F.col(f"hub.{c}").alias(f"{c}x") for c in ("id", "n", "b0", "b1", "component")]))
        both = self._meet(_named(members, "y"), hubs, nodes).where(_able(self.percent, self.most, "x", "y"))
        return both.select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b"))

    def _in_blocks(self, members: DataFrame) -> DataFrame:
        """(a, b) that link in whole nodes: each block of a node meets each other, with its sets, so no pair that doesn't link leaves a task."""
        parts = F.ceil(F.col("members") / PART).cast("int")
        placed = members.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("id"), parts).cast("int")}).join(self.sets, "id")
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        both = placed.select("node", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", "component", "packed")
        return both.groupBy("node", "low", "high").applyInArrow(_linked_in_block(self.percent), "a long, b long").distinct()

    def _link(self, pairs: DataFrame) -> None:
        """Confirms pairs: of each class the one with the least partner, then what is not connected yet."""
        pairs = self.written(pairs.distinct())
        if pairs.isEmpty():
            return
        self._keep_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        first = self.written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        self._add(self._similar(first))
        apart = lambda x: self.components.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
        rest = pairs.join(first, ["a", "b"], "left_anti").join(apart("a"), "a", "left").join(apart("b"), "b", "left")
        rest = self.written(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
        if not rest.isEmpty():
            self._add(self._similar(rest))

    def _add(self, edges: DataFrame) -> None:
        edges = self.written(edges)
        self.edges = edges if self.edges is None else self.edges.unionByName(edges)
        self.components = self.written(components(self.edges))

    def _keep_sets(self, ids: DataFrame) -> None:
        """Makes the sets of classes that have none yet, from their whole texts."""
        ids = ids.distinct()
        ids = self.written(ids if self.sets is None else ids.join(self.sets.select("id"), "id", "left_anti"))
        if ids.isEmpty():
            return
        texts = self.classes.select("id", "rep").join(ids, "id").join(self.docs.select(F.col(self.id_col).alias("rep"), F.col(self.text_col).alias("text")), "rep").select("id", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", SLICE):
                    rows = part.num_rows
                    value, start = sets(*grams(*words(*utf8(part.column(1))), rows, WIDTH), rows)
                    own = digests(value, start).view(np.int64) == np.asarray(part.column(0))  # rows that share an id may differ
                    packed = [value[x:y].tobytes() for x, y in zip(start[:-1], start[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["id", "packed"]).filter(pa.array(own))

        # Texts are exchanged by class, as they are smaller than sets; the sets made of them stay where they are for all joins that follow.
        parts = shuffle_partitions(self.docs.sparkSession)
        made = texts.repartition(parts, "id").mapInArrow(run, "id long, packed binary")
        made = self.folder.bucketed(made.dropDuplicates(["id"]).repartition(parts, "id") if self.repeated else made, "id")
        self.sets = made if self.sets is None else self.sets.unionByName(made)

    def _similar(self, pairs: DataFrame) -> DataFrame:
        of = lambda x: self.sets.select(F.col("id").alias(x), F.col("packed").alias(f"s{x}"))
        return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(_confirmed(self.percent), "a long, b long")


def _named(members: DataFrame, x: str) -> DataFrame:
    return members.withColumnsRenamed({c: f"{c}{x}" for c in ("id", "n", "b0", "b1", "component")})


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id reachable by links) and kept.

    Documents link if their sets of three-word shingles have a Jaccard similarity of ``percent`` / 100 or more; every
    link is confirmed on whole sets, and one at the threshold is missed with a chance below 1 - ``recall``. Null and
    empty texts have no shingles and link with nothing. Rows with a null id are not linked: their component is null
    and they are kept. Repeated rows and copies share a component; rows that repeat the kept id are all kept. Other
    columns are not read, and an empty table gives an empty result.
    """
    join = Join(docs, id_col, text_col, percent, recall)
    join.run()
    classes = join.classes.select(F.col("id").alias("class_id"), "rep")
    if join.components is not None:
        placed = classes.join(join.components.withColumnRenamed("id", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
        # Written first, so that the joins read plain exchanges, of which adaptive execution splits a large component or class.
        least = checkpoint(placed.groupBy("component").agg(F.min("rep").alias("component_id")))
        classes = placed.join(least, "component").select("class_id", "component_id")
    else:
        classes = classes.withColumnRenamed("rep", "component_id")
    classes = checkpoint(classes)
    join.folder.remove()
    out = join.rows.select(id_col, F.col("n").alias("n_shingles"), "class_id").join(classes, "class_id", "left")
    own = F.when(F.col(id_col).isNotNull(), F.coalesce("component_id", id_col))
    out = out.select(id_col, "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
