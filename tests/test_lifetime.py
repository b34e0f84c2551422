"""Streams whose state has a lifetime: equal to the batch queries, and forgotten in time."""

import random
import time

import pytest

from tidemark.streaming import lifetime

DAY = 86_400


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def counted(reports, seconds, limit):
    """By brute force: (thing, second, reports within the window up to it)."""
    out = {(t, s): sum(t2 == t and s - seconds <= s2 <= s for t2, s2 in reports) for t, s in reports}
    return sorted((str(t), s, n) for (t, s), n in out.items() if n >= limit)


def throttle(spark, folder, out, seconds=3600, limit=3, **given):
    stream = spark.readStream.schema("thing string, second long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    stream = stream.selectExpr("thing", "timestamp_seconds(second) AS at")
    lifetime.throttle_stream(stream, "thing", "at", out, seconds, limit, **given).awaitTermination()
    return sorted((str(r["thing"]), r["second"], r["reports"]) for r in lifetime.throttle_table(spark, out).collect())


def test_throttle_stream_equals_brute_force_in_any_order(spark, tmp_path):
    rng, zero = random.Random(3), 19_800 * DAY
    reports = [(rng.choice(["a", "a", "b", None]), zero + rng.randrange(2 * DAY) // 97 * 97) for _ in range(400)]
    for k in range(4):
        write(spark, tmp_path / "in", str(k), [*reports[k::4], ("a", None)], "thing string, second long")
    got = throttle(spark, str(tmp_path / "in"), str(tmp_path / "out"), lateness="3 days")
    assert got == counted(reports, 3600, 3) and len(got) > 100


def test_reports_older_than_a_week_are_gone(spark, tmp_path):
    zero = 19_800 * DAY
    write(spark, tmp_path / "in", "0", [("a", zero + k) for k in range(5)], "thing string, second long")
    assert len(throttle(spark, str(tmp_path / "in"), str(tmp_path / "out"), seconds=10 * DAY)) == 3
    reader = lambda: spark.read.format("statestore").option("stateVarName", "days").load(str(tmp_path / "out" / "state"))
    assert reader().count() == 1
    write(spark, tmp_path / "in", "1", [("b", zero + 9 * DAY)], "thing string, second long")
    throttle(spark, str(tmp_path / "in"), str(tmp_path / "out"), seconds=10 * DAY)
    assert [r[0] for r in reader().selectExpr("key.thing").collect()] == ["b"]
    write(spark, tmp_path / "in", "2", [("a", zero + 9 * DAY + k) for k in range(1, 3)], "thing string, second long")
    assert len(throttle(spark, str(tmp_path / "in"), str(tmp_path / "out"), seconds=10 * DAY)) == 3  # two new ones are below the limit


def test_retry_stream_in_any_order_and_its_lifetime(spark, tmp_path):
    schema = "id long, at long, kind string, reason string, success boolean"

    def run(out, **given):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        lifetime.retry_stream(stream, str(tmp_path / out), **given).awaitTermination()
        return sorted(tuple(r) for r in lifetime.retry_table(spark, str(tmp_path / out)).select("id", "kind", "reason", "failures", "state").collect())

    write(spark, tmp_path / "in", "0", [(1, 5, "pdf", "late", None), (1, 9, None, None, True), (2, 1, "doc", None, None), (3, 1, None, None, True)], schema)
    assert run("o", ttl_ms=1500) == [(1, "pdf", "late", 1, "fixed"), (2, "doc", None, 1, "unattempted")]
    time.sleep(2)
    write(spark, tmp_path / "in", "1", [(1, 3, "pdf", "first", None), (1, 8, None, None, False), (2, 2, None, None, False)], schema)
    assert run("o", ttl_ms=1500) == [(1, "pdf", "first", 1, "failed"), (2, "doc", None, 1, "unattempted")]  # all was forgotten
    assert run("p") == [(1, "pdf", "first", 2, "fixed"), (2, "doc", None, 1, "failed")]


@pytest.mark.parametrize("name", ["throttle_stream", "retry_stream"])
def test_the_sessions_state_store_stays(spark, small_dir, name):
    from tidemark.plans import QUERIES

    before = spark.conf.get(lifetime.PROVIDER, None)
    assert QUERIES[name](spark, small_dir).count() > 0 and spark.conf.get(lifetime.PROVIDER, None) == before


def test_a_thing_costs_few_calls_on_the_state():
    """Before, each of a thing's days cost two calls, and its timer was looked up and set anew in each batch."""
    zero, calls, kept, timers = 19_800 * DAY, [], [], set()

    class Handle:
        def __getattr__(self, name):
            return lambda *_: calls.append(name) or self

        def getListState(self, *_):  # noqa: N802
            return self

        def get(self):
            calls.append("get")
            return iter(list(kept))

        def put(self, days):
            calls.append("put")
            kept[:] = days

        def registerTimer(self, at):  # noqa: N802
            calls.append("registerTimer")
            timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            calls.append("deleteTimer")
            timers.remove(at)

    class Times:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    throttle, expiry = lifetime.Throttle(3600, 2, 7 * DAY), lambda day: (zero + (day + 1 + 7) * DAY) * 1000
    throttle.init(Handle())
    told = lambda *seconds: calls.clear() or [(r["thing"], r["second"] - zero, r["reports"]) for r in throttle.handleInputRows(("a",), iter([{"second": zero + s} for s in seconds]), Times(0))]
    assert told(*[k * DAY for k in range(30)]) == [] and calls == ["get", "put", "registerTimer"] and timers == {expiry(0)}
    assert told(29 * DAY + 3600, 29 * DAY + 3601) == [("a", 29 * DAY + 3600, 2), ("a", 29 * DAY + 3601, 2)] and calls == ["get", "put"]
    assert told(-60) == [("a", 0, 2)] and calls == ["get", "put", "deleteTimer", "registerTimer"] and timers == {expiry(-1)}
    calls.clear()
    assert list(throttle.handleExpiredTimer(("a",), Times(expiry(27)), Times(expiry(-1)))) == []
    assert calls == ["get", "put", "registerTimer"] and [d for d, _, _ in kept] == [zero // DAY + 28, zero // DAY + 29] and expiry(28) in timers


def test_one_timer_a_thing_is_left(spark, tmp_path):
    zero = 19_800 * DAY
    for k, rows in enumerate(([("a", 20), ("b", 20), (None, 21)], [("a", 14), ("a", 33)], [("b", 33), ("a", 34)])):
        write(spark, tmp_path / "in", str(k), [(t, zero + d * DAY) for t, d in rows], "thing string, second long")
        throttle(spark, str(tmp_path / "in"), str(tmp_path / "out"), lateness="10 days")
    load = lambda **o: spark.read.format("statestore").options(**o).load(str(tmp_path / "out" / "state"))
    days = {(r[0], r[1] - 19_800) for r in load(stateVarName="days").selectExpr("key.thing", "list_element.day").collect()}
    # The watermark is at day 24: what was over a week old, day 14, is gone.
    assert days == {("a", 20), ("a", 33), ("a", 34), ("b", 20), ("b", 33), (None, 21)}
    timers = sorted((str(r[0]), r[1] // 1000 // DAY - 19_800 - 8) for r in load(readRegisteredTimers="true").selectExpr("key.thing", "expiration_timestamp_ms").collect())
    assert timers == [("None", 21), ("a", 20), ("b", 20)]
