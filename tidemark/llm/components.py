"""Connected components of an edge table by randomised contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint

#: Edges that one task may finish.
SMALL = 20_000


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node of its component) of at most ``SMALL`` edges."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            above[max(a, b)] = min(a, b)
    if above:
        yield pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array([root(x) for x in above], pa.int64())], names=["u", "to"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node of an edge; ``component`` is the smallest id of the node's component.

    In the first round every node moves to its smallest neighbour (or stays), which takes up stars around
    small ids at once; in later rounds to the one with the least value of a hash that is new in that round.
    Edges inside a new node vanish and parallel ones become one. The expected number of nodes falls by a
    constant factor a round whatever the shape, so chains and stars alike take few rounds. When at most
    ``SMALL`` edges are left, one task joins their ends. Nothing but the number of edges left reaches the
    driver. Ids are longs; null ends are left out.
    """
    left = checkpoint(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    labels = None
    turn = 0
    while n := left.count():
        if n <= SMALL:
            to = checkpoint(left.coalesce(1).mapInArrow(_union, "u long, to long"))
        else:
            both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
            rank = lambda c: F.xxhash64(c, F.lit(turn)) if turn else F.lit(0)  # noqa: E731, B023
            to = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("rank"), F.col("v").alias("v"))).alias("m"))
            to = checkpoint(to.select("u", F.when(F.struct(rank("u"), "u") < F.struct("m.rank", "m.v"), F.col("u")).otherwise(F.col("m.v")).alias("to")))
        if labels is None:
            labels = to.select(F.col("u").alias("id"), F.col("to").alias("label"))
        else:
            labels = labels.join(to.withColumnRenamed("u", "label"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        if n <= SMALL:
            break
        left = left.join(to.withColumnRenamed("to", "pu"), "u").join(to.select(F.col("u").alias("v"), F.col("to").alias("pv")), "v")
        left = checkpoint(left.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        turn += 1
    if labels is None:
        return edges.select(F.col(a).alias("id"), F.col(a).alias("component")).limit(0)
    if not turn:  # the only task had all edges, so its labels are the smallest ids
        return labels.withColumnRenamed("label", "component")
    labels = checkpoint(labels)
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(least, "label").select("id", "component")
