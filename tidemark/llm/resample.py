"""Importance resampling towards a target: array-scored weights, weighted median-of-medians selection.

Features are words, hashed into ``BUCKETS`` buckets by crc32. Counting takes one pass over each side, with at most a
row for each bucket and task; the log gains of all buckets fit in one array of fixed size, which goes to every task.
A document's weight is the sum of its features' gains; adding a Gumbel variate drawn from its id makes the highest
scores a sample without replacement.

The highest scores are found without sorting all: each turn takes the median of the remaining keys of each partition,
and of these medians the one with half of the remaining keys behind it, by the partitions' remaining sizes. At least
a quarter of the keys lies on either side, so whichever side can't hold the cutoff goes. When ``FEW`` keys are left,
sorting these gives the exact cutoff. Only what beats it is then sorted, in ranges that are numbered by running sums.
A key is (score downwards, rows without an id last, id, row), so all keys differ whatever rows repeat.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from tidemark.llm.common import checkpoint, slices, utf8

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Keys among which the cutoff is found by sorting.
FEW = 20_000
#: Winners in a range that one task numbers, on average.
RANGE = 200_000
#: Words of more bytes are hashed one by one.
LONG = 48

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _table() -> np.ndarray:
    """The table of crc32, made from its polynomial."""
    n = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        n = np.where(n & 1, (n >> 1) ^ np.uint32(0xEDB88320), n >> 1).astype(np.uint32)
    return n


_TABLE = _table()


def word_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each word of the texts, in order: crc32 of its lower-case bytes, all words one byte further a turn."""
    n = len(data)
    letter = _LETTER[data]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    first[inner] = letter[inner]
    last[inner - 1] = letter[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = _LOWER[data]
    size = end - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    for k in np.flatnonzero(size > LONG):
        crc[k] = zlib.crc32(low[start[k] : end[k]].tobytes()) ^ 0xFFFFFFFF
    order = np.argsort(np.where(size > LONG, 0, size), kind="stable")[::-1]
    ascending = np.sort(np.where(size > LONG, 0, size))
    for k in range(min(int(ascending[-1]), LONG) if len(ascending) else 0):
        on = order[: len(ascending) - np.searchsorted(ascending, k, side="right")]
        c = crc[on]
        crc[on] = _TABLE[(c ^ low[start[on] + k]) & 0xFF] ^ (c >> np.uint32(8))
    bucket = (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % buckets
    return bucket, np.searchsorted(offsets, start, side="right") - 1


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, of all texts; ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, text_col):
                total += np.bincount(word_buckets(*utf8(part.column(0)), buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    n = len(source)
    whole_s, whole_t = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * whole_s / ((s + 1.0) * whole_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n_features, weight) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, row = word_buckets(*utf8(part.column(1)), len(sent.value))
                sums = np.append(0, np.cumsum(sent.value[bucket]))
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(np.diff(sums[at]))], names=[id_col, "n_features", "weight"])

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_features long, weight long")


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each partition that has keys: its median and their number."""
    parts = [b for b in batches if b.num_rows]
    if parts:
        table = pa.Table.from_batches(parts)
        score, without, id_, row = (np.asarray(pc.fill_null(c, 0) if c.null_count else c) for c in table.columns)
        at = np.lexsort((row, id_, without, score))[(len(row) - 1) // 2]
        yield pa.RecordBatch.from_arrays([pa.array([x[at]]) for x in (score, without, id_, row)] + [pa.array([len(row)])], names=["score", "without", "id", "row", "n"])


def cutoff(keys: DataFrame, number: int) -> tuple | None:
    """The key (score, without, id, row) that stands at place ``number`` of the ascending order; None if there is none.

    Each turn reads the keys between two bounds. A row for each partition reaches the driver, and a task holds the keys
    of its partition (25 bytes each).
    """
    left, total, want = keys, keys.count(), number
    if not 0 < number <= total:
        return None
    kept = total
    while total > FEW:
        medians = [(tuple(r)[:4], r["n"]) for r in left.mapInArrow(_medians, "score long, without boolean, id long, row long, n long").collect()]
        medians.sort()
        seen, pivot = 0, medians[-1][0]
        for key, n in medians:
            seen += n
            if 2 * seen >= total:
                pivot = key
                break
        first = left.where(_until(pivot))
        below = first.count()
        left, total, want = (first, below, want) if want <= below else (left.where(~_until(pivot)), total - below, want - below)
        if 4 * total < kept:  # turns read what is left, not all
            left, kept = checkpoint(left), total
    return tuple(left.orderBy("score", "without", "id", "row").offset(want - 1).limit(1).first())


def _until(key: tuple):
    """Condition on (score, without, id, row): not behind ``key``. A missing id counts as 0 behind its mark."""
    own = F.struct("score", "without", F.coalesce("id", F.lit(0)), "row")
    return own <= F.struct(*[F.lit(v or 0).cast(t) for v, t in zip(key, ("long", "boolean", "long", "long"), strict=True)])


def ranked(rows: DataFrame, order: list[str], number: int) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the given order, whose last column must tell all rows apart."""
    placed = checkpoint(rows.repartitionByRange(max(1, -(-number // RANGE)), *order).withColumn("part", F.spark_partition_id()))
    sizes = sorted(placed.groupBy("part").count().collect())
    before = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    offset = F.create_map(*[F.lit(x) for (part, _), n in zip(sizes, before[:-1], strict=True) for x in (part, n)])
    return placed.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)) + offset[F.col("part")])


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
    buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score, rank; ``percent`` of those with ``least_words`` words have one.

    Null and empty texts have no features and weight 0. A null id is hashed as the empty text and comes after other ids
    at equal scores. Rows that repeat each stand alone: they have equal scores, and if the cutoff falls among them, some
    are drawn. An empty table gives an empty result, an empty target flat shares. Other columns are not read. Ids must
    be whole numbers.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be a whole number")
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log(u)))
    scored = weights(docs, gain, id_col, text_col).withColumn("score", score)
    own = F.struct(id_col, "n_features", "weight", "score").alias("kept")
    keyed = scored.select((-F.col("score")).alias("score"), F.col(id_col).isNull().alias("without"), F.col(id_col).cast("long").alias("id"), "n_features", own)
    keyed = checkpoint(keyed.withColumn("row", F.monotonically_increasing_id()))
    keys = checkpoint(keyed.where(F.col("n_features") >= least_words).select("score", "without", "id", "row"))
    number = percent * keys.count() // 100
    last = cutoff(keys, number)
    if last is None:
        return keyed.select("kept.*", F.lit(None).cast("long").alias("rank"))
    beats = (F.col("n_features") >= least_words) & _until(last)
    drawn = ranked(keyed.where(beats), ["score", "without", "id", "row"], number).select("kept.*", F.col("rank").cast("long").alias("rank"))
    return drawn.unionByName(keyed.where(~beats).select("kept.*", F.lit(None).cast("long").alias("rank")))
