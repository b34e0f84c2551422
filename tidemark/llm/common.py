"""What the text operators share: reading, folds, checkpoints, and splitting Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder of the session and cuts its lineage.

    Only a session on one machine may name none, as in tests; it gets a temporary one. On a cluster that folder
    would be another one on each machine, so a missing name is an error there.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


class Folder:
    """Tables written for a job of many turns, in a folder of their own in the checkpoint folder of the session.

    Unlike a checkpoint a written table has the size of its files. The estimates that checkpoints carry multiply from
    join to join, so that after a dozen turns planning takes longer than the work.
    """

    def __init__(self, spark: SparkSession):
        if spark.sparkContext.getCheckpointDir() is None:
            checkpoint(spark.range(0))
        self.spark, self.path, self.tables = spark, f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}", 0
        self.names: list[str] = []

    def written(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.path}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        """As ``written``, once exchanged by ``key`` and kept in buckets of it, so that joins on it don't exchange the table again.

        ``df``: rows of one partition of ``key`` each, as ``repartition(shuffle_partitions(spark), key)`` makes them.
        """
        self.tables += 1
        name = f"tables_{uuid.uuid4().hex}"
        df.write.bucketBy(shuffle_partitions(self.spark), key).option("path", f"{self.path}/{self.tables}").format("parquet").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def remove(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array one after another, and where each row starts (rows + 1); null is empty."""
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Returns to the system what Python and Arrow have freed: workers stay between stages, and memory that one stage no longer needs would be missing in the next."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose text has about ``most`` bytes; one row at least, so no text is cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    total = np.cumsum(np.asarray(sizes, dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + most, side="right")))
        yield batch.slice(start, end - start)
        start = end
    give_back()
