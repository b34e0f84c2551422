"""Persons, parties and speaking time, shown on customers, orders, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import relational as R
from tidemark.operators.names import resolve_names
from tidemark.plans import query
from tidemark.sources.tables import table


@query("""
SELECT o_custkey, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS party, strftime(max(o_orderdate), '%Y-%m-%d') AS since, count(*) AS seats
FROM orders GROUP BY o_custkey""")
def party_of_person_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person's party by the seat taken last; one aggregation with partial results."""
    seats = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("party"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("since"), F.count(F.lit(1)).alias("seats"),
    )
    return seats


@query("""
WITH s AS (SELECT o_custkey AS person, o_orderpriority AS party, o_orderdate AS van, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS tot FROM orders),
f AS (SELECT event_type, user_id AS person, TIMESTAMP '1995-01-01' + to_days(CAST(event_id % 2400 AS INTEGER)) AS moment, CAST(floor(value) AS BIGINT) AS secs FROM events),
j AS (SELECT event_type, party, sum(secs)::BIGINT AS total FROM f JOIN s USING (person) WHERE van < moment AND (moment <= tot OR tot IS NULL) GROUP BY 1, 2),
e AS (SELECT * FROM (SELECT DISTINCT event_type FROM j), (SELECT DISTINCT party FROM j))
SELECT event_type, party, coalesce(total, 0) AS total,
  round(CASE WHEN sum(coalesce(total, 0)) OVER (PARTITION BY event_type) = 0 THEN 0 ELSE 100.0::DOUBLE * coalesce(total, 0) / sum(coalesce(total, 0)) OVER (PARTITION BY event_type) END, 6) AS share
FROM e LEFT JOIN j USING (event_type, party)""")
def interval_join_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each party in each meeting; the party is the one that the speaker belonged to at the time."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    seats = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("party"), F.col("o_orderdate").alias("van"), F.lead("o_orderdate").over(by).alias("tot")
    )
    at = F.expr("TIMESTAMP_NTZ '1995-01-01' + make_dt_interval(cast(event_id % 2400 AS int))")
    facts = table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("person"), at.alias("at"), F.floor("value").alias("secs"))
    held = R.within_interval(facts, seats, "person", "at", "van", "tot")
    return R.zero_filled_share(held, "event_type", "party", "secs").withColumn("share", F.round("share", 6))


@query("""
SELECT conv_id, role, round(sum(length(text)) / 60.0::DOUBLE, 1) AS minutes, replace(printf('%.1f', round(sum(length(text)) / 60.0::DOUBLE, 1)), '.', ',') AS shown, count(*) AS turns
FROM conversations GROUP BY conv_id, role""")
def minutes_per_meeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes spoken in each meeting."""
    out = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.round(F.sum(F.length("text")) / F.lit(60.0), 1).alias("minutes"), F.count(F.lit(1)).alias("turns"))
    return out.withColumn("shown", X.comma_decimal(F.col("minutes")))


@query("""
SELECT conv_id, sum(length(text))::BIGINT AS seconds, coalesce(sum(length(text)) FILTER (WHERE role = 'user'), 0)::BIGINT AS speaker_seconds,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS interrupter_seconds, coalesce(sum(length(text)) FILTER (WHERE role = 'system'), 0)::BIGINT AS chair_seconds
FROM conversations GROUP BY conv_id""")
def speaking_time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaking time by role, in one aggregation."""
    size = F.length("text").cast("long")
    of = {"speaker_seconds": "user", "interrupter_seconds": "assistant", "chair_seconds": "system"}
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sum(size).alias("seconds"), *[F.coalesce(F.sum(F.when(F.col("role") == role, size)), F.lit(0)).alias(name) for name, role in of.items()]
    )


@query("""
SELECT c_custkey, c_name, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, '[' || string_agg(DISTINCT '"' || o_orderpriority || '"', ',' ORDER BY '"' || o_orderpriority || '"') || ']' AS parties
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name""")
def persons_with_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All persons with the first day they sat and the set of their parties as JSON."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    parties = F.to_json(F.array_sort(F.collect_set("o_orderpriority")))
    return rows.groupBy("c_custkey", "c_name").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"), parties.alias("parties"))


@query("""
SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON c_custkey = o_custkey WHERE strftime(o_orderdate, '%Y-%m-%d') LIKE '%-03-15'""")
def birthdays(spark: SparkSession, sf_dir: str, month: int = 3, day: int = 15) -> DataFrame:
    """Sitting members whose day it is."""
    rows = table(spark, sf_dir, "orders").where((F.month("o_orderdate") == month) & (F.dayofmonth("o_orderdate") == day))
    return table(spark, sf_dir, "customer").join(rows, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""
WITH p AS (SELECT p_partkey AS person, split_part(p_name, ' ', 1) AS given, array_to_string(string_split(p_name, ' ')[2:], ' ') AS surname, '' AS infix FROM part),
k AS (SELECT given, infix, surname, min(person) AS person, count(*) AS n FROM p GROUP BY ALL)
SELECT k.given || ' ' || k.surname AS speaker, CASE WHEN n = 1 THEN person END AS person FROM k""")
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers matched with persons by name; only a unique match counts."""
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    people = part.select(F.col("p_partkey").alias("person"), F.get(words, F.lit(0)).alias("given"), F.lit("").alias("infix"), F.array_join(F.slice(words, F.lit(2), F.size(words)), " ").alias("surname"))
    speakers = people.select("given", "surname").distinct().select(F.concat_ws(" ", "given", "surname").alias("speaker"), "given", "surname")
    return resolve_names(speakers, people).select("speaker", "person")
