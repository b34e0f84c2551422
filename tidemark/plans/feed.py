"""The change feed, indexes and state tables, shown on events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.operators import state as ST
from tidemark.plans import query
from tidemark.sources.tables import table


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("""
SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry of each key."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", _stamp("ts").alias("at"), F.struct("ts", "event_id").alias("version"))
    return R.latest_by(rows, ["user_id"], "version").select("user_id", "event_id", "event_type", "at")


@query("""
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn > 1""")
def superseded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries that a newer one of their key replaces."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return R.others_per(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("""
SELECT user_id, event_id, event_type, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events) WHERE rn = 1 AND event_type <> 'error'""")
def feed_upsert_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that a feed of writes and tombstones leaves."""
    changes = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))
    return ST.apply_changes(None, changes, "user_id", "event_id", F.col("event_type") == "error")


@query("""
SELECT user_id, event_id, event_type, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events) WHERE rn = 1 AND event_type <> 'error'""")
def feed_upsert_batches(spark: SparkSession, sf_dir: str, batches: int = 3) -> DataFrame:
    """The same table from batches that come out of order: tombstones are remembered, so older writes stay hidden."""
    changes = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.round("value", 4).alias("value"))
    batch, state = F.pmod(F.xxhash64("event_id"), F.lit(batches)), None
    for k in range(batches):
        state = ST.merge_changes(state, changes.where(batch == k), "user_id", "event_id", F.col("event_type") == "error")
    return ST.visible(state)


@query("""
WITH e AS (SELECT user_id AS van, event_type AS naar, event_id AS seq FROM events WHERE event_type <> 'error'),
l AS (SELECT van, naar, max(seq) AS seq FROM e GROUP BY 1, 2), t AS (SELECT user_id AS id, max(event_id) AS dead FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT van, naar, seq FROM l LEFT JOIN t ON van = id WHERE dead IS NULL OR seq > dead""")
def feed_edges_after_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that are left after tombstones in the order of arrival; the last of equal pairs stays."""
    events = table(spark, sf_dir, "events")
    edges = events.where("event_type <> 'error'").select(F.col("user_id").cast("string").alias("van"), F.col("event_type").alias("naar"), F.col("event_id").alias("seq"))
    dead = events.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"))
    return ST.surviving_edges(edges, dead, "seq").select(F.col("van").cast("bigint").alias("van"), "naar", "seq")


@query("SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) * 9 // 10 FROM events)")
def incremental_scan(spark: SparkSession, sf_dir: str, token: int | None = None) -> DataFrame:
    """Entries after a stored token; the filter reaches the scan."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    token = events.agg(F.max("event_id")).first()[0] * 9 // 10 if token is None else token
    return events.where(F.col("event_id") > token)


@query("""
SELECT user_id, count(*) AS reports FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY GROUP BY user_id HAVING count(*) >= 2""")
def throttle(spark: SparkSession, sf_dir: str, seconds: int = 5 * 86400, limit: int = 2) -> DataFrame:
    """Things that failed too often lately."""
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return ST.throttled(events.where("event_type = 'error'"), "user_id", "ts", now, seconds, limit)


@query("""
WITH f AS (SELECT user_id AS id, min_by(event_type, event_id) AS kind, min_by(props, event_id) AS reason, count(*) AS failures FROM events WHERE event_type IN ('error', 'view') GROUP BY 1),
a AS (SELECT user_id AS id, arg_max(value > 10, event_id) AS success FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT f.id, kind, reason, failures, CASE WHEN success IS NULL THEN 'unattempted' WHEN success THEN 'fixed' ELSE 'failed' END AS state FROM f LEFT JOIN a ON f.id = a.id""")
def retry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every failed conversion, with the number of its failures."""
    events = table(spark, sf_dir, "events")
    reports = events.where(F.col("event_type").isin("error", "view")).select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), F.col("props").alias("reason"), F.col("event_id").alias("at"))
    tried = events.where("event_type = 'purchase'").select(F.col("user_id").alias("id"), F.col("event_type").alias("how"), (F.col("value") > 10).alias("success"), F.col("event_id").alias("at"))
    return ST.conversion_state(reports, tried).select("id", "kind", "reason", "failures", "state")


@query("""
WITH o AS (SELECT doc_id, n_chars - (doc_id % 5 = 0)::INT AS n_chars, lang FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id + 1000000, n_chars, lang FROM documents WHERE doc_id % 7 = 0)
SELECT coalesce(o.doc_id, d.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'add' WHEN d.doc_id IS NULL THEN 'drop' WHEN o.n_chars <> d.n_chars THEN 'reindex' ELSE 'keep' END AS action
FROM o FULL JOIN documents d ON o.doc_id = d.doc_id""")
def index_change_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental index build has to do with each document; the older index is made up from the table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    kept = docs.where("doc_id % 3 <> 0").withColumn("n_chars", F.col("n_chars") - (F.col("doc_id") % 5 == 0).cast("int"))
    gone = docs.where("doc_id % 7 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    return ST.index_actions(kept.unionByName(gone), docs, "doc_id", "n_chars", "lang")


@query("""
WITH s AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'signup'), p AS (SELECT event_id AS purchase, user_id, ts AS moment, value AS paid FROM events WHERE event_type = 'purchase')
SELECT s.event_id, s.user_id, arg_min(purchase, (abs(epoch_us(s.ts) - epoch_us(moment)), purchase)) AS purchase, min(abs(epoch_us(s.ts) - epoch_us(moment))) AS gap
FROM s JOIN p USING (user_id) WHERE paid > value * 0.1 AND paid < value * 10 GROUP BY s.event_id, s.user_id""")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recording nearest in time to each meeting in its room, if their lengths are alike."""
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'signup'").select("event_id", "user_id", "ts", "value")
    right = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", F.col("ts").alias("at"), F.col("value").alias("paid"))
    return R.nearest(left, right, "user_id", "ts", "at", "value", "paid", "purchase").select("event_id", "user_id", "purchase", "gap")


@query("""
SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def feed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of the feed, by a stream over the files: entries once each in any order of the files, windows of a day."""
    from tidemark.streaming.feed import all_counts, run_once

    return run_once(spark, sf_dir, all_counts)


@query("""
WITH e AS (SELECT user_id AS thing, floor(epoch(ts))::BIGINT AS second, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2),
w AS (SELECT thing, second, sum(n) OVER (PARTITION BY thing ORDER BY second RANGE BETWEEN 432000 PRECEDING AND CURRENT ROW)::BIGINT AS reports FROM e)
SELECT * FROM w WHERE reports >= 2""")
def throttle_stream(spark: SparkSession, sf_dir: str, seconds: int = 5 * 86400, limit: int = 2) -> DataFrame:
    """When things failed too often, by a stream that keeps reports for a week. All files make one batch here, so none is late."""
    from tidemark.streaming import lifetime
    from tidemark.streaming.feed import read_feed, scratch

    folder = scratch(spark)
    errors = read_feed(spark, f"{sf_dir}/events.parquet", 1_000_000).where("event_type = 'error'")
    lifetime.throttle_stream(errors, "user_id", "ts", folder, seconds, limit).awaitTermination()
    return lifetime.throttle_table(spark, folder)


@query("""
WITH f AS (SELECT user_id AS id, min_by(event_type, event_id) AS kind, min_by(props, event_id) AS reason, count(*) AS failures FROM events WHERE event_type IN ('error', 'view') GROUP BY 1),
a AS (SELECT user_id AS id, arg_max(value > 10, event_id) AS success FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT f.id, kind, reason, failures, CASE WHEN success IS NULL THEN 'unattempted' WHEN success THEN 'fixed' ELSE 'failed' END AS state FROM f LEFT JOIN a ON f.id = a.id""")
def retry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every failed conversion by a stream whose state has a lifetime; equals ``retry_state``."""
    from tidemark.streaming import lifetime
    from tidemark.streaming.feed import read_feed, scratch

    folder = scratch(spark)
    events = read_feed(spark, f"{sf_dir}/events.parquet", 1_000_000)
    tried = F.when(F.col("event_type") == "purchase", F.coalesce(F.col("value") > 10, F.lit(False)))
    rows = events.where(F.col("event_type").isin("error", "view", "purchase")).select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.col("event_type").alias("kind"), F.col("props").alias("reason"), tried.alias("success"))
    lifetime.retry_stream(rows, folder).awaitTermination()
    return lifetime.retry_table(spark, folder)
