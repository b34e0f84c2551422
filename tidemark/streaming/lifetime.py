"""State that a stream keeps for a time: reports for a throttle (by event time), failed conversions (by age on the clock).

Both write one folder for each batch, so a batch that runs again writes the same folder again, and both are read with
one aggregation: ``throttle_table`` and ``retry_table``. The state is in RocksDB and in the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Throttle(StatefulProcessor):
    """Counts of reports by second in one list entry a day (86,400 numbers at most); a timer removes days that are over ``keep`` seconds old.

    Each call on the state is a message to the JVM and back, which costs more than what is done with it. So a thing's
    days are read with one call and written with one, and its timer is touched only when its oldest day changes.
    """

    def __init__(self, seconds: int, limit: int, keep: int):
        self.seconds, self.limit, self.keep = min(seconds, keep), limit, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getListState("days", "day long, seconds array<long>, counts array<long>")

    def _held(self) -> dict[int, tuple[list[int], list[int]]]:
        return {day: (seconds, counts) for day, seconds, counts in self.days.get()}

    def _put(self, held: dict[int, tuple[list[int], list[int]]], new: dict[int, int]) -> None:
        by_day: dict[int, dict[int, int]] = {}
        for second, n in new.items():
            by_day.setdefault(second // DAY, {})[second] = n
        for day, counts in by_day.items():
            for second, n in zip(*held.get(day, ((), ())), strict=True):
                counts[second] = counts.get(second, 0) + n
            order = sorted(counts)
            held[day] = (order, [counts[s] for s in order])
        self.days.put([(day, *held[day]) for day in sorted(held)])

    def _near(self, held: dict[int, tuple[list[int], list[int]]], new: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Seconds and counts of the days that the windows of new reports, and of those after them, can touch."""
        low, high = (new[0] - self.seconds) // DAY, (new[-1] + self.seconds) // DAY
        near = [held[day] for day in sorted(held) if low <= day <= high]
        return tuple(np.array([x for part in near for x in part[k]], dtype="int64") for k in range(2))

    def _expiry(self, day: int) -> int:
        return ((day + 1) * DAY + self.keep) * 1000

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new: dict[int, int] = {}
        for row in rows:
            new[row["second"]] = new.get(row["second"], 0) + 1
        held = self._held()
        oldest = min(held, default=None)
        self._put(held, new)
        first = sorted(new)
        at, n = self._near(held, first)
        total = np.concatenate([[0], np.cumsum(n)])
        reports = total[1:] - total[np.searchsorted(at, at - self.seconds)]
        # A late report changes the counts of later ones too: those within its window are told again.
        arrived = np.array(first, dtype="int64")
        before = np.searchsorted(arrived, at, "right")
        touched = (before > 0) & (at - arrived[np.maximum(before - 1, 0)] <= self.seconds) & (reports >= self.limit)
        # One timer for each thing: when its oldest day is to go.
        if min(held) != oldest:
            if oldest is not None:
                self.handle.deleteTimer(self._expiry(oldest))
            self.handle.registerTimer(self._expiry(min(held)))
        for second, n in zip(at[touched].tolist(), reports[touched].tolist(), strict=True):
            yield Row(thing=key[0], second=second, reports=n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        watermark = max(now, timerValues.getCurrentWatermarkInMs())
        left = {day: held for day, held in self._held().items() if self._expiry(day) > watermark}
        if left:
            self.days.put([(day, *left[day]) for day in sorted(left)])
            self.handle.registerTimer(self._expiry(min(left)))
        else:
            self.days.clear()
        return iter([])

    def close(self) -> None:
        pass


class Retry(StatefulProcessor):
    """The first report, the number of reports and the last attempt of one conversion; forgotten ``ttl`` ms after its last change."""

    SCHEMA = "first long, kind string, reason string, failures long, tried long, success boolean"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.SCHEMA, self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, kind, reason, failures, tried, success = self.state.get() if self.state.exists() else (None, None, None, 0, None, None)
        for part in rows:
            reports, attempts = part[part["success"].isna()], part[part["success"].notna()]
            failures += len(reports)
            if len(reports):
                r = reports.loc[reports["at"].idxmin()]
                if first is None or r["at"] < first:
                    first, kind, reason = int(r["at"]), *(None if pd.isna(r[c]) else r[c] for c in ("kind", "reason"))
            if len(attempts):
                a = attempts.loc[attempts["at"].idxmax()]
                if tried is None or a["at"] > tried:
                    tried, success = int(a["at"]), bool(a["success"])
        self.state.update((first, kind, reason, failures, tried, success))
        state = "unattempted" if success is None else "fixed" if success else "failed"
        yield pd.DataFrame({"id": [key[0]], "kind": [kind], "reason": [reason], "failures": [failures], "state": [state]}, dtype=object)[: min(failures, 1)]

    def close(self) -> None:
        pass


def _start(df: DataFrame, folder: str, **more: str):
    """The stream into a folder for each batch, with the state in RocksDB; the session's own settings are put back."""
    conf = df.sparkSession.conf
    settings = {PROVIDER: ROCKS} | more
    before = {name: conf.get(name, None) for name in settings}
    for name, value in settings.items():
        conf.set(name, value)
    try:
        keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        return df.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def throttle_stream(reports: DataFrame, thing: str, at: str, folder: str, seconds: int, limit: int, keep_days: int = 7, lateness: str = "0 seconds"):
    """Starts the throttle over a stream of reports: for each thing and second with a report, how many there were in the
    ``seconds`` up to it, once they are ``limit`` or more.

    A report that arrives late raises what later seconds within its window had. Reports are forgotten when the watermark
    is ``keep_days`` past the end of their day, and no window is longer than that; what comes later than ``lateness``
    is dropped. Reports without a time count for nothing; a null thing is a thing.
    """
    kind = reports.schema[thing].dataType.simpleString()
    rows = reports.where(F.col(at).isNotNull()).select(F.col(thing).alias("thing"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", lateness)
    rows = rows.withColumn("second", F.unix_seconds("at"))
    out = rows.groupBy("thing").transformWithState(Throttle(seconds, limit, keep_days * DAY), f"thing {kind}, second long, reports long", "update", "eventtime")
    return _start(out, folder)


def throttle_table(spark: SparkSession, folder: str) -> DataFrame:
    """(thing, second, reports) by the batches so far. Counts only grow, so the greatest is the last, whatever was written twice."""
    return spark.read.parquet(f"{folder}/out").groupBy("thing", "second").agg(F.max("reports").alias("reports"))


def retry_stream(rows: DataFrame, folder: str, ttl_ms: int = 7 * DAY * 1000):
    """Starts the retry state over a stream of (id, at, kind, reason, success): reports have a null ``success``, attempts have one.

    The first report by ``at`` names kind and reason, the last attempt by ``at`` decides the state, in any order of
    arrival. A conversion without change for ``ttl_ms`` is forgotten: what follows is a new one.
    """
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("id", "at", "kind", "reason", "success").groupBy("id").transformWithStateInPandas(Retry(ttl_ms), f"id {kind}, kind string, reason string, failures long, state string", "update", "processingtime")
    # State by the clock asks for another batch for ever, so only data makes one; state that is too old is unseen by then.
    return _start(out, folder, **{NO_DATA: "false"})


def retry_table(spark: SparkSession, folder: str) -> DataFrame:
    """(id, kind, reason, failures, state) as the last batch that changed it left each conversion; those with reports only."""
    written = spark.read.parquet(f"{folder}/out")
    last = written.groupBy("id").agg(F.max_by(F.struct("kind", "reason", "failures", "state"), "batch").alias("r"))
    return last.select("id", "r.*")
