"""Upserts, tombstones and other state that tables keep between runs, as pure functions of DataFrames."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.relational import latest_by


#: Marks the tombstones that a state keeps.
DELETED = "is_deleted"


def merge_changes(state: DataFrame | None, changes: DataFrame, key: str, seq: str, deleted: Column) -> DataFrame:
    """The state after a batch of changes: the last write of each key, tombstones included (``is_deleted``).

    ``state`` is what an earlier call returned. A change that arrives late does not undo a newer one, and a
    write that is older than a tombstone does not bring its row back, whatever the batches. Of a write and a
    tombstone with one ``seq`` the tombstone counts. Rows with a null key are one key.
    """
    marked = changes.withColumn(DELETED, deleted)
    if state is not None:
        marked = marked.unionByName(state)
    order = F.struct(F.col(seq), F.col(DELETED))
    last = marked.groupBy(key).agg(F.max_by(F.struct(*[c for c in marked.columns if c != key]), order).alias("last"))
    return last.select(*[F.col(c) if c == key else F.col("last").getField(c).alias(c) for c in marked.columns])


def visible(state: DataFrame) -> DataFrame:
    """The rows of a state that no tombstone has removed."""
    return state.where(~F.col(DELETED)).drop(DELETED)


def apply_changes(state: DataFrame | None, changes: DataFrame, key: str, seq: str, deleted: Column) -> DataFrame:
    """The visible table after a batch of changes.

    ``state`` is one of ``merge_changes``, or a table without tombstones; from the latter a write that is older
    than a forgotten tombstone can't be told from a new one.
    """
    if state is not None and DELETED not in state.columns:
        state = state.withColumn(DELETED, F.lit(False))
    return visible(merge_changes(state, changes, key, seq, deleted))


def materialise(df: DataFrame, name: str, keep: int = 2) -> None:
    """Writes a query's result as a new version and then lets the view ``name`` show it, by one statement.

    A reader finds the older result or the new one and never nothing; one that has begun goes on with the version it
    found, as the newest ``keep`` stay. If writing fails, the view is as it was. Versions are folders below the
    warehouse, which a cluster shares.
    """
    spark = df.sparkSession
    root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}__versions"
    version = f"v{time.time_ns():020d}"
    df.write.parquet(f"{root}/{version}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{root}/{version}`")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    older = sorted(f.getPath().getName() for f in fs.listStatus(path) if f.getPath().getName() < version)
    for name_of in older[: max(len(older) + 1 - keep, 0)]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, name_of), True)


def append(df: DataFrame, path: str, day: str) -> None:
    """Adds rows to a table that is kept by day."""
    df.write.mode("append").partitionBy(day).parquet(path)


def recent(rows: DataFrame, day: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last ``days`` days, for retention and for rolling indexes; on a table kept by day it reads those days only."""
    return rows.where(F.col(day) > F.date_format(F.date_sub(as_of.cast("date"), days), "yyyy-MM-dd"))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Bulk delete: rows whose key is not in ``gone``; a null key stays."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def surviving_edges(edges: DataFrame, tombstones: DataFrame, seq: str, ends: tuple[str, str] = ("van", "naar")) -> DataFrame:
    """Edges without those that a later tombstone of either end has removed; of equal pairs the last stays.

    ``tombstones``: (id, seq). An edge written after the tombstone survives.
    """
    last = latest_by(edges, list(ends), seq)
    dead = tombstones.groupBy("id").agg(F.max(seq).alias("__dead"))
    for end in ends:
        last = last.join(dead.withColumnRenamed("id", end), end, "left").where(F.col("__dead").isNull() | (F.col(seq) > F.col("__dead"))).drop("__dead")
    return last


def count_failures(reports: DataFrame, key: str, order: str, first: list[str]) -> DataFrame:
    """One row for each key: the columns of its first report and the number of reports."""
    kept = F.min_by(F.struct(*first), order)
    rows = reports.groupBy(key).agg(kept.alias("r"), F.count(F.lit(1)).alias("failures"))
    return rows.select(key, *[F.col(f"r.{c}").alias(c) for c in first], "failures")


def conversion_state(reports: DataFrame, attempts: DataFrame) -> DataFrame:
    """State of every failed conversion: ``unattempted``, ``fixed`` or ``failed`` by the last attempt.

    ``reports``: (id, kind, reason, at); ``attempts``: (id, how, success, at).
    """
    failed = count_failures(reports, "id", "at", ["kind", "reason"])
    last = latest_by(attempts.select("id", "how", "success", F.col("at").alias("attempted_at")), ["id"], "attempted_at")
    state = F.when(F.col("success").isNull(), "unattempted").when(F.col("success"), "fixed").otherwise("failed")
    return failed.join(last, "id", "left").withColumn("state", state)


def throttled(reports: DataFrame, thing: str, at: str, as_of: Column, seconds: int, limit: int, keep_days: int = 7) -> DataFrame:
    """Things with at least ``limit`` reports in the last ``seconds``; reports older than ``keep_days`` are forgotten."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    recent = reports.where((age >= 0) & (age <= min(seconds, keep_days * 86400) * 1_000_000))
    return recent.groupBy(thing).agg(F.count(F.lit(1)).alias("reports")).where(F.col("reports") >= limit)


def index_actions(indexed: DataFrame, current: DataFrame, key: str, size: str, changed: str) -> DataFrame:
    """What has to be done with each row of a search index: add, drop, reindex or keep."""
    old = indexed.select(key, F.col(size).alias("old_size"), F.col(changed).alias("old_changed"))
    both = current.select(key, size, changed, F.lit(True).alias("now")).join(old.withColumn("then", F.lit(True)), key, "full")
    differs = ~F.col(size).eqNullSafe(F.col("old_size")) | ~F.col(changed).eqNullSafe(F.col("old_changed"))
    action = F.when(F.col("then").isNull(), "add").when(F.col("now").isNull(), "drop").when(differs, "reindex").otherwise("keep")
    return both.select(key, action.alias("action"))
