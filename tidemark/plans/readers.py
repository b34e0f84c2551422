"""Feeds of committees, searches and monitors, and what hits are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import feeds
from tidemark.plans import query
from tidemark.plans.cases import newest
from tidemark.plans.pages import _HITS, _hits
from tidemark.sources.tables import table

_LEAD = "SELECT DISTINCT l_orderkey, n_nationkey, n_name FROM lineitem JOIN nation ON n_nationkey = l_suppkey % 25 WHERE l_returnflag = 'A'"
_ITEM = """o_orderpriority AS title, coalesce(naam, '') || ' | Stuk ' || o_orderkey || ' ' || o_orderpriority AS description, 'document.html?nummer=' || o_orderkey AS link,
  'record_' || o_orderkey AS guid, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') AS pubdate"""
_COMMITTEE = f"""
WITH c AS (SELECT n_name AS feed, o_orderdate AS at, {_ITEM} FROM (SELECT *, n_name AS naam FROM orders JOIN ({_LEAD}) ON l_orderkey = o_orderkey)
  WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 100 DAY)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        number.alias("nummer"), F.col("o_orderpriority").alias("onderwerp"), F.concat(F.lit("Stuk "), number.cast("string")).alias("titel"), F.col("o_orderdate").alias("bijgewerkt"),
    )


def _lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nummer, naam): the lead committees of each document."""
    actors = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("nummer"), (F.col("l_suppkey") % 25).alias("n_nationkey")).distinct()
    return actors.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_name").alias("naam")), "n_nationkey").select("nummer", "naam")


@query(_COMMITTEE + " SELECT * FROM c")
def committee_feeds(spark: SparkSession, sf_dir: str, days: int = 100, as_of=None) -> DataFrame:
    """The items of the feeds of all committees: recent documents of cases that a committee leads."""
    docs = _documents(spark, sf_dir)
    recent = docs.where(F.col("bijgewerkt") > F.lit(newest(docs, "bijgewerkt", as_of)) - F.expr(f"INTERVAL {days} DAYS"))
    return feeds.items(recent.join(_lead(spark, sf_dir), "nummer"), F.col("naam"), F.col("bijgewerkt"))


@query(_COMMITTEE + """
SELECT n_name AS feed, coalesce(n, 0) AS items, '<?xml version="1.0" encoding="utf-8" standalone="yes"?><rss version="2.0"><channel>'
  || coalesce('<lastBuildDate>' || dated || '</lastBuildDate>', '<pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate>') || '<title>Commissie ' || n_name || ' RSS</title><description>Documenten voor ' || n_name
  || '</description><link>https://example.org/</link>' || coalesce(body, '') || '</channel></rss>' AS xml
FROM nation LEFT JOIN (SELECT feed, count(*) AS n, arg_max(pubdate, "at") AS dated,
  string_agg('<item><title>' || title || '</title><description>' || description || '</description><link>' || link || '</link><guid>' || guid || '</guid><pubDate>' || pubdate || '</pubDate></item>', '' ORDER BY "at" DESC, guid) AS body
  FROM c GROUP BY 1) ON feed = n_name""")
def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feeds of all committees as the XML that readers get, those without items too."""
    name = F.col("n_name")
    every = table(spark, sf_dir, "nation").select(name.alias("feed"), F.concat(F.lit("Commissie "), name, F.lit(" RSS")).alias("title"), F.concat(F.lit("Documenten voor "), name).alias("about"))
    return feeds.channels(committee_feeds(spark, sf_dir), every, "https://example.org/", F.lit("2024-01-01").cast("timestamp"))


@query(f"""
SELECT DISTINCT c_name AS feed, ts AS at, {_ITEM} FROM events JOIN customer ON user_id = c_custkey JOIN orders ON o_orderkey = event_id
LEFT JOIN (SELECT l_orderkey, min(n_name) AS naam FROM ({_LEAD}) GROUP BY 1) ON l_orderkey = o_orderkey""")
def monitor_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of the feeds of all users: the documents of the messages that they were sent, by the time of sending; what is no document has no item."""
    sent = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_id").alias("nummer"), F.col("ts"))
    users = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    lead = _lead(spark, sf_dir).groupBy("nummer").agg(F.min("naam").alias("naam"))
    rows = sent.join(users, "c_custkey").join(_documents(spark, sf_dir), "nummer").join(lead, "nummer", "left")
    return feeds.items(rows, F.col("c_name"), F.col("ts"))


@query(f"""
WITH {_HITS} SELECT DISTINCT 'eran OR the' AS feed, o_orderdate AS at, {_ITEM} FROM k JOIN orders ON category = 'Document' AND o_orderkey = doc_id
LEFT JOIN (SELECT l_orderkey, min(n_name) AS naam FROM ({_LEAD}) GROUP BY 1) ON l_orderkey = o_orderkey""")
def search_feed(spark: SparkSession, sf_dir: str, typed: str = "eran OR the") -> DataFrame:
    """The items of the feed of a search: the documents that it finds."""
    found = _hits(spark, sf_dir, typed).where("category = 'Document'").select(F.col("doc_id").alias("nummer"))
    lead = _lead(spark, sf_dir).groupBy("nummer").agg(F.min("naam").alias("naam"))
    return feeds.items(found.join(_documents(spark, sf_dir), "nummer").join(lead, "nummer", "left"), F.lit(typed), F.col("bijgewerkt"))


@query(f"""
WITH {_HITS} SELECT doc_id AS nummer, category, CASE category WHEN 'Document' THEN coalesce(o_orderpriority, '')
  WHEN 'Activiteit' THEN coalesce(p_type || ' ' || p_name || CASE WHEN p_size % 3 = 0 THEN ' (nog geen datum)' ELSE ' (' || strftime(DATE '2024-01-01' + p_size::INT, '%Y-%m-%d') || ' 10:00:00)' END, '')
  WHEN 'Toezegging' THEN coalesce('Toezegging van ' || c_name || ' (' || c_mktsegment || '): nr ' || c_custkey, '')
  WHEN 'PersoonGeschenk' THEN coalesce('Geschenk aan A ' || CASE WHEN s_suppkey % 2 = 0 THEN 'van' ELSE '' END || ' ' || s_name || ': vaas', '') END AS description
FROM h LEFT JOIN orders ON o_orderkey = doc_id LEFT JOIN part ON p_partkey = doc_id LEFT JOIN customer ON c_custkey = doc_id LEFT JOIN supplier ON s_suppkey = doc_id""")
def hit_descriptions(spark: SparkSession, sf_dir: str, typed: str = "eran OR the") -> DataFrame:
    """What each hit of a search is, in the words of its category."""
    t = lambda name, key, *columns: table(spark, sf_dir, name).select(F.col(key).alias("nummer"), *columns)
    on = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")), "yyyy-MM-dd")
    tables = {
        "Document": t("orders", "o_orderkey", F.col("o_orderpriority").alias("onderwerp")),
        "Activiteit": t("part", "p_partkey", F.col("p_type").alias("soort"), F.col("p_name").alias("onderwerp"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(on, F.lit("T10:00:00"))).alias("datum")),
        "Toezegging": t("customer", "c_custkey", F.col("c_name").alias("naam"), F.col("c_mktsegment").alias("ministerie"), F.concat(F.lit("nr "), F.col("c_custkey").cast("string")).alias("tekst")),
        "PersoonGeschenk": t("supplier", "s_suppkey", F.lit("A").alias("roepnaam"), F.when(F.col("s_suppkey") % 2 == 0, "van").otherwise("").alias("tussenvoegsel"), F.col("s_name").alias("achternaam"), F.lit("vaas").alias("omschrijving")),
    }
    hits = _hits(spark, sf_dir, typed).select(F.col("doc_id").alias("nummer"), "category")
    return feeds.described(hits, tables)
