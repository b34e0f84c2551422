"""The change feed as a stream: counts over event time, and upserts of a table batch by batch."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.state import merge_changes, visible

#: Buckets of a table that a stream keeps.
BUCKETS = 64


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below the session's checkpoint folder if it names one."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}" if base else os.path.join(tempfile.mkdtemp(prefix="stream-"), "s")


def read_feed(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The files of a table as a stream, some at a time; where it left off is kept with the query's checkpoint."""
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files)
    folder, _, name = path.rpartition("/")
    if any(f.endswith(f"/{name}") for f in table.inputFiles()):  # a table of one file
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


def daily_counts(stream: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """Entries by day and type, each id once; a day is final when the watermark has passed it, later entries are dropped."""
    once = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("at", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def all_counts(stream: DataFrame) -> DataFrame:
    """Entries by day and type, each id once, whatever order the files come in: no watermark, so nothing is late. For complete mode."""
    once = stream.withColumn("at", F.col("ts").cast("timestamp")).dropDuplicates(["event_id"])
    return once.groupBy(F.window("at", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_once(spark: SparkSession, sf_dir: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a plan over all that is there now and returns the table it wrote: complete mode, so every batch writes all windows anew."""
    folder = scratch(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total")).write.mode("overwrite").parquet(f"{folder}/out")

    query = plan(read_feed(spark, f"{sf_dir}/events.parquet")).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _newest(table: DataFrame, before: int | None = None) -> DataFrame:
    """The rows of the newest version of each bucket. There are at most ``BUCKETS`` rows of places on the driver, and they choose the folders that are read."""
    if before is not None:
        table = table.where(F.col("version") < before)
    places = table.groupBy("bucket").agg(F.max("version").alias("version")).collect()
    here = F.lit(False)
    for r in places:
        here |= (F.col("bucket") == r["bucket"]) & (F.col("version") == r["version"])
    return table.where(here)


def _stored(spark: SparkSession, table_path: str) -> DataFrame | None:
    """What the versions hold; None before the first one that has rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not any(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/version=*/bucket=*"))):
        return None
    return spark.read.option("basePath", table_path).parquet(table_path)


def upsert_stream(stream: DataFrame, table_path: str, checkpoint: str, key: str, seq: str, deleted: str):
    """Keeps a table of the last write of each key, with its tombstones, in buckets of keys. Batches may be empty, the first one too.

    A batch reads and writes only the buckets it has changes for, as folders ``version=<batch>/bucket=<b>``; a
    batch that is run again after a failure writes the same folders again. ``current`` shows the newest version
    of every bucket, ``expire`` removes the others.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        batch = batch.withColumn("bucket", bucket)
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # BUCKETS at most
        if not touched:
            return
        state = _stored(spark, table_path)
        if state is not None:
            state = _newest(state.where(F.col("bucket").isin(touched)), number).drop("version")
        merged = merge_changes(state, batch, key, seq, F.expr(deleted))
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{table_path}/version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table_path: str) -> DataFrame:
    """The visible rows of a table kept by ``upsert_stream``, once a batch has had rows."""
    return visible(_newest(_stored(spark, table_path)).drop("version", "bucket"))


def expire(spark: SparkSession, table_path: str) -> int:
    """Removes the folders that newer versions of their bucket have replaced, and returns their number; for times without readers."""
    places = [(r["bucket"], r["version"]) for r in _stored(spark, table_path).select("bucket", "version").distinct().collect()]
    newest = {}
    for bucket, version in places:
        newest[bucket] = max(version, newest.get(bucket, -1))
    old = [(bucket, version) for bucket, version in places if version < newest[bucket]]
    for bucket, version in old:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/version={version}/bucket={bucket}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(old)
