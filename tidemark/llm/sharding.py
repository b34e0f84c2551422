"""Sharding by jump consistent hashing.

A key and the number of shards decide the shard; there is no ring table. With one more shard a key stays
or goes to the new shard, so about 1/(n+1) of the keys move. Slots number the rows of a shard without gaps,
in the order of the key's first generator state (a bijection of the key), so they do not depend on how
Spark cut the input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import checkpoint, shuffle_partitions

LAW = "key"
#: Constant of the published algorithm's linear congruential generator.
_STEP = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard (0 to shards - 1) of each 64-bit key."""
    state = keys.astype(np.uint64)
    at, following = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    going = np.ones(len(state), bool)
    while going.any():
        at[going] = following[going]
        state = state * np.uint64(_STEP) + np.uint64(1)
        jumped = (at + 1) * (float(1 << 31) / ((state >> np.uint64(33)).astype(np.float64) + 1))
        following = np.where(going, np.minimum(jumped, 1e15).astype(np.int64), following)
        going &= following < shards
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Column of the shard of a long key; a null key counts as 0."""

    @F.pandas_udf("int")
    def run(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64), shards).astype(np.int32))

    return run(F.coalesce(key, F.lit(0).cast("long")))


def _order(key: Column) -> Column:
    """The first generator state of a key, as a signed long whose order is the unsigned one."""

    @F.pandas_udf("long")
    def run(k: pd.Series) -> pd.Series:
        state = k.to_numpy(np.int64).astype(np.uint64) * np.uint64(_STEP) + np.uint64(1)
        return pd.Series((state ^ np.uint64(1 << 63)).astype(np.int64))

    return run(F.coalesce(key, F.lit(0).cast("long")))


#: Rows that one array holds when a row is repeated.
PART = 1 << 16


def long_key(df: DataFrame, name: str) -> Column:
    """Integers stand for themselves; other types are hashed to a long."""
    kind = df.schema[name].dataType
    return F.col(name).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(name)


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 1 << 17) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    A null id has key 0; a null text has no bytes (size 1, crc of the empty text). Rows that repeat get
    slots of their own; ties in id are ordered by size and crc. An empty table gives an empty result and
    other columns are not read.

    Slots: equal (id, size, crc) rows are counted first, so one key may hold any share of the rows. Each
    shard is cut into ranges of the order value, ranges are numbered by themselves, and the counts of the
    ranges (a few per ``block_rows`` rows) give their offsets.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType
    groups = docs.select(
        F.col(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    groups = groups.groupBy(id_col, "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    key = long_key(groups, id_col)
    groups = checkpoint(groups.withColumns({"shard": shard_of(key, shards), "grown_shard": shard_of(key, shards + 1), "order": _order(key)}))
    rows = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()["rows"]
    ranges = max(4 * shuffle_partitions(spark), rows // block_rows)
    # Rounding to double keeps the order, so ranges follow one another.
    groups = groups.withColumn("range", F.floor((F.col("order").cast("double") / float(1 << 64) + 0.5) * ranges).cast("int"))
    offsets = groups.groupBy("shard", "range").agg(F.sum("n").alias("in_range"))
    by = Window.partitionBy("shard").orderBy("range")
    offsets = offsets.select("shard", "range", (F.sum("in_range").over(by) - F.col("in_range")).alias("before"))
    inner = Window.partitionBy("shard", "range").orderBy("order", F.col(id_col), "size", "text_crc32")
    ranked = groups.withColumn("first", F.sum("n").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    placed = ranked.join(offsets, ["shard", "range"])
    # Rows that repeat are written out in parts, so that no array grows with their number.
    start, end = F.col("before") + F.col("first"), F.col("before") + F.col("first") + F.col("n") - 1
    placed = placed.select("*", F.explode(F.sequence(start, end, F.lit(PART).cast("long"))).alias("part"))
    slots = F.explode(F.sequence(F.col("part"), F.least(F.col("part") + PART - 1, end)))
    out = placed.select(id_col, "size", "text_crc32", F.lit(LAW).alias("law"), "shard", slots.alias("slot"), "grown_shard")
    return out.withColumn(id_col, F.col(id_col).cast(kind))


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id") -> None:
    """Writes all columns of ``docs`` under ``path/shard=k``; every writing task adds a file to each shard it has rows of.

    A null id has key 0; empty and null texts are rows like others; rows that repeat are written as often; a
    column ``shard`` is replaced; an empty table writes no shard.
    """
    key = long_key(docs, id_col)
    docs.withColumn("shard", shard_of(key, shards)).write.partitionBy("shard").mode("overwrite").parquet(path)
