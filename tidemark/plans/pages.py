"""Pages, reports and index builders that put several tables together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.functions import text as X
from tidemark.operators import monitors as M
from tidemark.operators import state as ST
from tidemark.plans import query
from tidemark.plans.cases import day, newest
from tidemark.plans.texts import _has, stored_index
from tidemark.search import engine as S
from tidemark.sources import enclosures, publications
from tidemark.sources.tables import TABLES, table
from tidemark.streaming.feed import scratch


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query("""
WITH d AS (
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS datum, o_orderkey::VARCHAR AS nummer, o_orderpriority AS onderwerp, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus ELSE 'Stuk ' || o_orderkey END AS titel,
    replace(replace(strftime(o_orderdate, '%Y-%m-%d %H:%M'), ' ', chr(160)), '-', chr(8209)) AS bijgewerkt, coalesce(s_name, '') AS afkorting, o_orderstatus AS soort,
    row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, s_name) AS rn
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'A' LEFT JOIN supplier ON s_suppkey = l_suppkey
  WHERE o_orderpriority <> '5-LOW' AND o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 8 DAY)
SELECT datum, nummer, onderwerp, titel, bijgewerkt, afkorting, soort FROM d WHERE rn = 1
UNION ALL SELECT strftime(ts, '%Y-%m-%d'), substr(md5(event_id::VARCHAR), 1, 8), props, 'Verslag (' || CASE WHEN value > 10 THEN 'Gecorrigeerd' ELSE 'Ongecorrigeerd' END || ')',
  replace(replace(strftime(ts, '%Y-%m-%d %H:%M'), ' ', chr(160)), '-', chr(8209)), 'Steno', 'Verslag' FROM events WHERE event_type = 'view' AND ts > (SELECT max(ts) FROM events) - INTERVAL 8 DAY""")
def home_recent(spark: SparkSession, sf_dir: str, days: int = 8, only: list[str] | None = None, as_of=None) -> DataFrame:
    """Documents of the last days, each number once and with its leading actor, and transcripts, in one list by date; ``only`` some kinds of documents."""
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    docs = orders.where((F.col("o_orderpriority") != "5-LOW") & (F.col("o_orderdate") > F.lit(newest(orders, "o_orderdate", as_of)) - F.expr(f"INTERVAL {days} DAYS")))
    if only:
        docs = docs.where(F.col("o_orderstatus").isin(only))
    lead = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "s_name")
    rows = docs.join(lead, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = rows.groupBy("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus").agg(F.min_by("s_name", F.struct(F.coalesce("l_linenumber", F.lit(1 << 30)), "s_name")).alias("naam"))
    stamp = lambda c: X.unbroken(F.date_format(c, "yyyy-MM-dd HH:mm"))
    titel = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("Stuk "), F.col("o_orderkey").cast("string")))
    documents = rows.select(
        day("o_orderdate").alias("datum"), F.col("o_orderkey").cast("string").alias("nummer"), F.col("o_orderpriority").alias("onderwerp"), X.default_if_empty(titel, F.col("o_orderstatus")).alias("titel"),
        stamp("o_orderdate").alias("bijgewerkt"), X.text_or(F.col("naam")).alias("afkorting"), F.col("o_orderstatus").alias("soort"),
    )
    spoken = events.where((F.col("event_type") == "view") & (F.col("ts") > F.lit(newest(events, "ts", as_of)) - F.expr(f"INTERVAL {days} DAYS")))
    status = F.when(F.col("value") > 10, "Gecorrigeerd").otherwise("Ongecorrigeerd")
    transcripts = spoken.select(
        day("ts").alias("datum"), X.short_id(F.md5(F.col("event_id").cast("string").cast("binary"))).alias("nummer"), F.col("props").alias("onderwerp"), F.concat(F.lit("Verslag ("), status, F.lit(")")).alias("titel"),
        stamp("ts").alias("bijgewerkt"), F.lit("Steno").alias("afkorting"), F.lit("Verslag").alias("soort"),
    )
    return documents.unionByName(transcripts).orderBy(F.desc("datum"), F.desc("bijgewerkt"))


@query("""
SELECT l_orderkey, l_linenumber, c_name AS persoon, s_name AS commissie, n_name AS fractie, p_size AS gewicht
FROM lineitem, orders, customer, supplier, nation, region, part
WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND l_partkey = p_partkey
  AND r_name = 'EUROPE' AND l_linestatus = 'O' AND o_orderstatus = 'O' AND p_size NOT IN (1, 2, 3)""")
def committee_members(spark: SparkSession, sf_dir: str, region: str = "EUROPE") -> DataFrame:
    """Members whose seat, membership and party are still open: seven tables."""
    t = lambda name: table(spark, sf_dir, name)
    seats = t("lineitem").where("l_linestatus = 'O'").join(t("orders").where("o_orderstatus = 'O'"), F.col("l_orderkey") == F.col("o_orderkey"))
    parties = t("nation").join(t("region").where(F.col("r_name") == region), F.col("n_regionkey") == F.col("r_regionkey"))
    people = t("customer").join(parties, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = seats.join(people, F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(t("part").where(~F.col("p_size").isin(1, 2, 3)), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_linenumber", F.col("c_name").alias("persoon"), F.col("s_name").alias("commissie"), F.col("n_name").alias("fractie"), F.col("p_size").alias("gewicht"))


_FUNCTIONS = ("minister van Financiën", "staatssecretaris van Sociale Zaken en Werkgelegenheid", "minister-president", "Tweede Kamerlid", "minister voor Klimaat en Groene Groei", "minister van Onbekende Zaken")
_QUESTIONS = f"""
q AS (SELECT o_orderkey AS q, o_orderdate AS gestart, n_name AS fractie, s_nationkey AS aantal FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN supplier ON 'D' || s_suppkey = 'D' || (o_custkey % 200) WHERE o_orderstatus = 'O'),
f AS (SELECT l_orderkey AS q, ({list(_FUNCTIONS)})[(l_partkey % 6 + 1)::INT] AS functie, l_returnflag = 'R' AS uitstel FROM lineitem),
m AS (SELECT DISTINCT q, CASE WHEN b = 'minister-president' THEN 'Algemene Zaken' ELSE b END AS naam FROM (
  SELECT q, replace(replace(replace(functie, 'minister van ', ''), 'minister voor ', ''), 'staatssecretaris van ', '') AS b FROM f WHERE functie LIKE '%inister%' OR functie LIKE '%taatssecretaris%'))"""


@query(f"""
WITH {_QUESTIONS},
a (naam, afko) AS (VALUES ('Algemene Zaken', 'AZ'), ('Financiën', 'FIN'), ('Sociale Zaken en Werkgelegenheid', 'SZW'), ('Klimaat en Groene Groei', 'KGG'))
SELECT 'ministerie' AS facet, m.naam AS waarde, coalesce(afko, m.naam) AS afko, count(*) AS n FROM m JOIN q USING (q) LEFT JOIN a ON a.naam = m.naam GROUP BY ALL
UNION ALL SELECT 'fractie', fractie, '', count(*) FROM q GROUP BY fractie
UNION ALL SELECT 'laat zonder uitstel', '', '', count(*) FROM q WHERE gestart < (SELECT max(o_orderdate) FROM orders) - INTERVAL 21 DAY AND NOT EXISTS (SELECT 1 FROM f WHERE f.q = q.q AND uitstel)
UNION ALL SELECT 'aantal vragen', '', '', coalesce(sum(aantal), 0)::BIGINT FROM q""")
def open_question_facets(spark: SparkSession, sf_dir: str, as_of=None) -> DataFrame:
    """Open questions, with their statistics joined by natural key: counts by ministry asked (once each) and by party, late ones, and the number of single questions."""
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders")
    stats = t("supplier").select(F.concat(F.lit("D"), F.col("s_suppkey").cast("string")).alias("documentnummer"), F.col("s_nationkey").alias("aantal"))
    asked = orders.where("o_orderstatus = 'O'").withColumn("docunummer", F.concat(F.lit("D"), (F.col("o_custkey") % 200).cast("string")))
    asked = asked.join(stats, F.col("docunummer") == F.col("documentnummer"), "left").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    functions = F.array(*[F.lit(x) for x in _FUNCTIONS])
    actor = t("lineitem").select("l_orderkey", X.addressee(F.get(functions, (F.col("l_partkey") % 6).cast("int"))).alias("aan"), (F.col("l_returnflag") == "R").alias("uitstel"))
    actors = actor.groupBy("l_orderkey").agg(F.collect_set("aan").alias("aan"), F.max("uitstel").alias("uitstel"))
    rows = asked.join(actors, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderdate", F.col("n_name").alias("fractie"), "aantal", "aan", F.coalesce("uitstel", F.lit(False)).alias("uitstel"))
    late = (F.col("o_orderdate") < F.lit(newest(orders, "o_orderdate", as_of)) - F.expr("INTERVAL 21 DAYS")) & ~F.col("uitstel")
    # One pass: every question gives an entry to each of its facets.
    one, entry = F.lit(1).cast("long"), lambda facet, value, n: F.struct(F.lit(facet).alias("facet"), value.alias("waarde"), n.alias("n"))
    entries = F.concat(
        F.transform(F.coalesce("aan", F.array().cast("array<string>")), lambda a: entry("ministerie", a, one)),
        F.array(entry("fractie", F.col("fractie"), one), entry("laat zonder uitstel", F.lit(""), late.cast("long")), entry("aantal vragen", F.lit(""), F.coalesce(F.col("aantal").cast("long"), F.lit(0).cast("long")))),
    )
    facets = rows.select(F.explode(entries).alias("e")).groupBy("e.facet", "e.waarde").agg(F.sum("e.n").alias("n"))
    return facets.select("facet", "waarde", F.when(F.col("facet") == "ministerie", X.ministry_short(F.col("waarde"))).otherwise("").alias("afko"), "n")


@query("""
SELECT DISTINCT substr(n_name, 1, 3) AS afko, n_name AS naam, replace(substr(n_name, 1, 3), ' ', '%20') AS escaped FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 4 DAY""")
def planned_committees(spark: SparkSession, sf_dir: str, as_of=None) -> DataFrame:
    """The different committees of the planned activities, with the form of the abbreviation that links use."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.where(F.col("o_orderdate") > F.lit(newest(orders, "o_orderdate", as_of)) - F.expr("INTERVAL 4 DAYS"))
    rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    pairs = rows.select(F.substring("n_name", 1, 3).alias("afko"), F.col("n_name").alias("naam")).distinct()
    return pairs.withColumn("escaped", X.url_escape(F.col("afko"))).orderBy("afko", "naam")


@query("""
SELECT o_orderpriority AS title, c_name || ' | Stuk ' || o_orderkey || ' ' || o_orderpriority AS description, 'document.html?nummer=' || o_orderkey AS link, 'record_' || o_orderkey AS guid,
  strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') AS pubdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 8 DAY""")
def rss_items(spark: SparkSession, sf_dir: str, days: int = 8, as_of=None) -> DataFrame:
    """The items of a feed of recent documents."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.where(F.col("o_orderdate") > F.lit(newest(orders, "o_orderdate", as_of)) - F.expr(f"INTERVAL {days} DAYS")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    number = F.col("o_orderkey").cast("string")
    return rows.select(
        F.col("o_orderpriority").alias("title"), F.concat(F.col("c_name"), F.lit(" | Stuk "), number, F.lit(" "), F.col("o_orderpriority")).alias("description"),
        F.concat(F.lit("document.html?nummer="), number).alias("link"), F.concat(F.lit("record_"), number).alias("guid"), X.rss_date(F.col("o_orderdate")).alias("pubdate"),
    )


@query("""
WITH a AS (SELECT l_orderkey, string_agg(' ' || p_name || ' ' || regexp_replace('<p>' || p_type || '</p>', '<[^>]*>', ' ', 'g'), '' ORDER BY l_linenumber, p_name, p_type) AS punten, strftime(min(l_shipdate), '%Y-%m-%d') AS geregistreerd
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS datum FROM orders WHERE o_orderdate > DATE '2001-06-01')
SELECT 'Activiteit' AS category, 'a' || o_orderkey AS uuid, o_orderpriority AS onderwerp, o_orderstatus AS titel, o_orderpriority || coalesce(punten, '') AS tekst, datum FROM o LEFT JOIN a ON l_orderkey = o_orderkey
UNION ALL SELECT 'Document', 'd' || o_orderkey, o_orderpriority, o_orderstatus, '', CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE greatest(datum, geregistreerd) END FROM o JOIN a ON l_orderkey = o_orderkey
UNION ALL SELECT 'Toezegging', 't' || event_id, props, '', 'toezegging ' || props || ' ' || event_type || ' ' || user_id, strftime(ts, '%Y-%m-%d') FROM events WHERE event_type = 'purchase'
UNION ALL SELECT 'PersoonGeschenk', 'g' || c_custkey, c_mktsegment, '', 'geschenk aan ' || c_name || '  ' || c_nationkey || ' ' || c_mktsegment, '' FROM customer""")
def index_entries(spark: SparkSession, sf_dir: str, since: str = "2001-06-01") -> DataFrame:
    """What goes into the search index, by category: activities with their agenda in order, documents with the later of two dates (none if one is missing), commitments and gifts."""
    t = lambda name: table(spark, sf_dir, name)
    text = lambda c: F.col(c).cast("string")
    points = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    point = F.struct("l_linenumber", "p_name", "p_type", F.concat(F.lit(" "), "p_name", F.lit(" "), X.strip_tags(F.concat(F.lit("<p>"), "p_type", F.lit("</p>")))).alias("body"))
    # An agenda is part of one activity's row in the index, so a group is as large as that row.
    points = points.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(point)).alias("points"), F.min(day("l_shipdate")).alias("registered"))
    points = points.withColumn("points", F.array_join(F.transform("points", lambda p: p["body"]), ""))
    orders = t("orders").where(F.col("o_orderdate") > F.lit(since).cast("date")).withColumn("datum", day("o_orderdate")).join(points, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    kind = lambda name, prefix, key: (F.lit(name).alias("category"), F.concat(F.lit(prefix), text(key)).alias("uuid"))
    subject, title = F.col("o_orderpriority").alias("onderwerp"), F.col("o_orderstatus").alias("titel")
    activities = orders.select(*kind("Activiteit", "a", "o_orderkey"), subject, title, F.concat("o_orderpriority", F.coalesce("points", F.lit(""))).alias("tekst"), "datum")
    registered = F.when(F.col("o_orderkey") % 3 != 0, F.col("registered"))
    documents = orders.where("l_orderkey IS NOT NULL").select(*kind("Document", "d", "o_orderkey"), subject, title, F.lit("").alias("tekst"), X.max_or_null(F.col("datum"), registered).alias("datum"))
    events = t("events").where("event_type = 'purchase'")
    commitments = events.select(*kind("Toezegging", "t", "event_id"), F.col("props").alias("onderwerp"), F.lit("").alias("titel"), F.concat_ws(" ", F.lit("toezegging"), "props", "event_type", text("user_id")).alias("tekst"), day("ts").alias("datum"))
    gifts = t("customer").select(
        *kind("PersoonGeschenk", "g", "c_custkey"), F.col("c_mktsegment").alias("onderwerp"), F.lit("").alias("titel"),
        F.concat_ws(" ", F.lit("geschenk aan"), "c_name", F.lit(""), text("c_nationkey"), "c_mktsegment").alias("tekst"), F.lit("").alias("datum"),
    )
    return _union([activities, documents, commitments, gifts])


@query("""
WITH i AS (SELECT doc_id, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS datum FROM documents)
SELECT doc_id FROM i WHERE doc_id % 7 <> 0 AND datum > strftime((SELECT max(datum)::DATE FROM i) - 14, '%Y-%m-%d')""")
def rolling_index(spark: SparkSession, sf_dir: str, days: int = 14, as_of=None) -> DataFrame:
    """The documents of a rolling index of two weeks, after those that are gone were deleted from it."""
    datum = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd")
    docs = table(spark, sf_dir, "documents").select("doc_id", datum.alias("datum"))
    gone = docs.where("doc_id % 7 = 0")
    return ST.without(ST.recent(docs, "datum", F.lit(newest(docs, "datum", as_of)), days), gone, "doc_id").select("doc_id")


#: Categories of the example: what a hit is, by id.
_CATEGORIES = ("Document", "Activiteit", "Toezegging", "PersoonGeschenk", "Onbekend")
_HITS = rf"""
h AS (SELECT doc_id, (['Document', 'Activiteit', 'Toezegging', 'PersoonGeschenk', 'Onbekend'])[(doc_id % 5 + 1)::INT] AS category, CASE WHEN doc_id % 11 = 0 THEN '' ELSE strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') END AS datum
  FROM documents WHERE {_has('eran')} OR {_has('the')}),
k AS (SELECT doc_id, category, datum, coalesce(o_orderkey::VARCHAR, 'p' || p_partkey, 'c' || c_custkey, 's' || s_suppkey, '') AS nummer, coalesce(o_orderpriority, p_name, 'Toezegging van ' || c_name, 'Geschenk aan ' || s_name, '') AS onderwerp, coalesce(o_orderpriority, '') AS soort
  FROM h LEFT JOIN orders ON category = 'Document' AND o_orderkey = doc_id LEFT JOIN part ON category = 'Activiteit' AND p_partkey = doc_id LEFT JOIN customer ON category = 'Toezegging' AND c_custkey = doc_id LEFT JOIN supplier ON category = 'PersoonGeschenk' AND s_suppkey = doc_id
  WHERE category = 'Onbekend' OR coalesce(o_orderkey, p_partkey, c_custkey, s_suppkey) IS NOT NULL)"""


def _hits(spark: SparkSession, sf_dir: str, typed: str) -> DataFrame:
    found = S.match(S.read_index(spark, stored_index(spark, sf_dir)), typed).select(F.col("doc").alias("doc_id"))
    category = F.get(F.array(*[F.lit(c) for c in _CATEGORIES]), (F.col("doc_id") % 5).cast("int"))
    dated = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd")
    return found.select("doc_id", category.alias("category"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(dated).alias("datum"))


def enriched(hits: DataFrame, details: dict[str, DataFrame], key: str = "doc_id", empty: tuple[str, ...] = ("nummer", "onderwerp", "soort")) -> DataFrame:
    """Hits with what the table of their category tells of them.

    ``details``: a table (key, nummer, onderwerp, soort) for each category. A hit that its table doesn't hold
    is dropped; one of an unknown category stays, with empty texts. One join, on category and key.
    """
    told = _union([d.withColumn("category", F.lit(name)) for name, d in details.items()])
    rows = hits.join(told, ["category", key], "left")
    known = F.col("category").isin(list(details))
    return rows.where(~known | F.col(empty[0]).isNotNull()).select(*hits.columns, *[F.coalesce(c, F.lit("")).alias(c) for c in empty])


def _details(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = lambda name, key, number, subject, kind="": table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), number.alias("nummer"), subject.alias("onderwerp"), (F.col(kind) if kind else F.lit("")).alias("soort"))
    text = lambda sign, key: F.concat(F.lit(sign), F.col(key).cast("string"))
    return {
        "Document": t("orders", "o_orderkey", text("", "o_orderkey"), F.col("o_orderpriority"), "o_orderpriority"),
        "Activiteit": t("part", "p_partkey", text("p", "p_partkey"), F.col("p_name")),
        "Toezegging": t("customer", "c_custkey", text("c", "c_custkey"), F.concat(F.lit("Toezegging van "), "c_name")),
        "PersoonGeschenk": t("supplier", "s_suppkey", text("s", "s_suppkey"), F.concat(F.lit("Geschenk aan "), "s_name")),
    }


@query(f"WITH {_HITS} SELECT doc_id, category, datum, nummer, onderwerp, soort FROM k")
def search_enriched(spark: SparkSession, sf_dir: str, typed: str = "eran OR the") -> DataFrame:
    """Hits of a search with number, subject and kind from the table of their category."""
    return enriched(_hits(spark, sf_dir, typed), _details(spark, sf_dir))


_KINDS = {"moties": ("1-URGENT",), "vragenantwoorden": ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")}


@query(f"""
WITH {_HITS}, p AS (SELECT k.*, datum = '' OR datum >= strftime((SELECT max(datum)::DATE FROM h WHERE datum <> '') - 60, '%Y-%m-%d') AS lately FROM k)
SELECT facet, twomonths, count(*) AS n FROM (SELECT unnest(['alles', CASE WHEN soort = '1-URGENT' THEN 'moties' END, CASE WHEN soort IN ('2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') THEN 'vragenantwoorden' END,
  CASE WHEN category = 'Activiteit' THEN 'activiteiten' END]) AS facet, unnest_lately AS twomonths FROM (SELECT *, unnest(CASE WHEN lately THEN [false, true] ELSE [false] END) AS unnest_lately FROM p)) WHERE facet IS NOT NULL GROUP BY ALL""")
def search_facets(spark: SparkSession, sf_dir: str, typed: str = "eran OR the", days: int = 60) -> DataFrame:
    """How many hits each choice of the search page would show: kinds of documents or category, of all times or of two months (hits without a date count)."""
    rows = enriched(_hits(spark, sf_dir, typed), _details(spark, sf_dir))
    last = rows.agg(F.max(F.nullif("datum", F.lit(""))).alias("last")).first()["last"]
    lately = (F.col("datum") == "") | (F.col("datum") >= F.date_format(F.date_sub(F.lit(last).cast("date"), days), "yyyy-MM-dd"))
    facets = [F.lit("alles"), *[F.when(F.col("soort").isin(*kinds), F.lit(name)) for name, kinds in _KINDS.items()], F.when(F.col("category") == "Activiteit", F.lit("activiteiten"))]
    rows = rows.select(F.explode(F.array_compact(F.array(*facets))).alias("facet"), lately.alias("lately"))
    counts = rows.select("facet", F.explode(F.when(F.col("lately"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("twomonths"))
    return counts.groupBy("facet", "twomonths").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, md5(doc_id::VARCHAR) AS uuid, lang FROM documents WHERE md5(doc_id::VARCHAR) = (SELECT md5(min(doc_id)::VARCHAR) FROM documents)")
def find_by_id(spark: SparkSession, sf_dir: str, uuid: str | None = None) -> DataFrame:
    """One document by its external id: a filter on the column, which reaches the scan where the table stores it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("uuid"), "lang")
    uuid = uuid or docs.agg(F.min_by("uuid", "doc_id")).first()[0]
    return docs.where(F.col("uuid") == uuid)


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n FROM {name}" for name in TABLES))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table, for the metrics page."""
    return _union([table(spark, sf_dir, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in TABLES])


@query("""
SELECT d.doc_id, n_chars AS size, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'wrongsize' END AS outcome FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
WHERE l.doc_id IS NULL OR strlen(text) <> n_chars""")
def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of stored files that are missing or have another size in bytes than was declared."""
    docs = table(spark, sf_dir, "documents")
    wanted = docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.lit(None).cast("string").alias("hash"))
    there = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    found = enclosures.audit(wanted, there.select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content"))).where("outcome <> 'ok'")
    return found.select(F.col("id").alias("doc_id"), "size", "outcome")


def write_report(rows: DataFrame, path: str) -> None:
    """A report as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


@query("""
WITH m AS (SELECT c_custkey AS id, (['activiteit', 'zaak', 'ksd', 'zoek', 'commissie', 'persoon', 'toezeggingen', 'OODocumentVerantwoordelijke'])[c_custkey % 8 + 1] AS soort, (c_custkey % 40)::VARCHAR AS nummer,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'VI' END AS toevoeging, CASE WHEN c_custkey // 8 % 3 = 0 THEN '' ELSE (c_custkey % 30)::VARCHAR END AS commissie, CASE WHEN c_custkey // 8 % 2 = 0 THEN '' ELSE 'F' || c_nationkey END AS fractie,
  'zorg ' || c_custkey % 5 AS query, CASE WHEN c_custkey // 8 % 2 = 0 THEN '' ELSE 'Document' END AS categorie, c_mktsegment AS verantwoordelijke FROM customer),
n AS (SELECT 'commissie' AS soort, n_nationkey::VARCHAR AS key, n_name AS name FROM nation UNION ALL SELECT 'persoon', s_suppkey::VARCHAR, s_name FROM supplier UNION ALL SELECT k, p_partkey::VARCHAR, p_name FROM part, (SELECT unnest(['activiteit', 'zaak']) AS k)
  UNION ALL SELECT 'ksd', p_partkey || ' VI', p_type FROM part)
SELECT id, CASE m.soort WHEN 'commissie' THEN coalesce(name, '') WHEN 'persoon' THEN 'Persoon ' || coalesce(name, '') WHEN 'activiteit' THEN 'Activiteit ' || nummer || ': ' || coalesce(name, '') WHEN 'zaak' THEN 'Zaak ' || nummer || ': ' || coalesce(name, '')
  WHEN 'ksd' THEN 'Kamerstukdossier ' || nummer || ' ' || coalesce(toevoeging, '') || ': ' || coalesce(name, '')
  WHEN 'toezeggingen' THEN CASE WHEN fractie <> '' THEN 'Toezeggingen aan fractie ' || fractie WHEN commissie <> '' THEN 'Toezeggingen aan commissie ' || commissie ELSE 'Alle toezeggingen' END
  WHEN 'zoek' THEN 'Zoekopdracht ' || query || CASE WHEN categorie <> '' THEN ' (categorie ' || categorie || ')' ELSE '' END ELSE 'Open.overheid.nl documenten van ' || verantwoordelijke END AS label
FROM m LEFT JOIN n ON n.soort = m.soort AND n.key = CASE m.soort WHEN 'commissie' THEN commissie WHEN 'ksd' THEN nummer || ' ' || coalesce(toevoeging, '') ELSE nummer END""")
def monitor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title for each monitor, of all eight kinds."""
    t = lambda name: table(spark, sf_dir, name)
    key, row = F.col("c_custkey"), F.floor(F.col("c_custkey") / 8)
    kinds = F.array(*[F.lit(s) for s in ("activiteit", "zaak", "ksd", "zoek", "commissie", "persoon", "toezeggingen", "OODocumentVerantwoordelijke")])
    text = lambda c: c.cast("string")
    monitors = t("customer").select(
        key.alias("id"), F.get(kinds, (key % 8).cast("int")).alias("soort"), text(key % 40).alias("nummer"), F.when(key % 3 != 0, "VI").alias("toevoeging"), F.when(row % 3 == 0, "").otherwise(text(key % 30)).alias("commissie"),
        F.when(row % 2 == 0, "").otherwise(F.concat(F.lit("F"), text(F.col("c_nationkey")))).alias("fractie"), F.concat(F.lit("zorg "), text(key % 5)).alias("query"), F.when(row % 2 == 0, "").otherwise("Document").alias("categorie"), F.col("c_mktsegment").alias("verantwoordelijke"),
    )
    named = lambda name, soort, key, label: t(name).select(F.lit(soort).alias("soort"), key.alias("key"), F.col(label).alias("name"))
    part = text(F.col("p_partkey"))
    names = [named("nation", "commissie", text(F.col("n_nationkey")), "n_name"), named("supplier", "persoon", text(F.col("s_suppkey")), "s_name"), named("part", "activiteit", part, "p_name"), named("part", "zaak", part, "p_name"), named("part", "ksd", F.concat(part, F.lit(" VI")), "p_type")]
    return M.describe(monitors, _union(names)).select("id", "label")


@query("""
WITH r AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS dag, row_number() OVER (ORDER BY ts, event_id) - 1 AS k FROM events),
d AS (SELECT DISTINCT dag AS day FROM r), l AS (SELECT day, dag, event_id, row_number() OVER (PARTITION BY day ORDER BY k) - 1 AS i FROM d JOIN r ON dag >= day AND dag <= strftime(day::DATE + 1, '%Y-%m-%d')),
p AS (SELECT *, i // 50 AS page, sum((dag <> day)::INT) OVER (PARTITION BY day, i // 50 ORDER BY i) AS other FROM l),
s AS (SELECT day, min(page) AS last FROM p WHERE other > 3 GROUP BY 1)
SELECT day, event_id::VARCHAR AS id FROM p LEFT JOIN s USING (day) WHERE (last IS NULL OR page <= last) AND other <= 3""")
def publication_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that each day's list of publications is read for: pages of 50 in order, until more than three of a page are of another day."""
    rows = table(spark, sf_dir, "events").where("ts IS NOT NULL").select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("at"))
    # The list of a day goes on with the next day, so an entry stands in the lists of its day and the one before.
    listed = F.array("at", F.date_format(F.date_sub(F.col("at").cast("date"), 1), "yyyy-MM-dd"))
    document = F.struct(F.col("event_id").cast("string").alias("id"), F.col("at").alias("openbaarmakingsdatum"))
    entry = F.struct(document.alias("document"))
    pages = publications.paged(rows.select("ts", "event_id", "at", listed.alias("days"), entry.alias("r")), "ts", ["event_id"], 50)
    days = rows.select(F.col("at").alias("day")).distinct()
    pages = pages.join(F.broadcast(days), "day", "left_semi").select("day", "page", F.to_json(F.struct("resultaten")).alias("json"))
    return publications.of_day(pages).select("day", F.col("r.document.id").alias("id"))


_LOCAL = "epoch(o_orderdate::TIMESTAMP - to_hours(CASE WHEN o_orderdate >= make_date(year(o_orderdate), 4, 1) AND o_orderdate < make_date(year(o_orderdate), 10, 1) THEN 2 ELSE 1 END))::BIGINT"


@query(f"""
SELECT o_orderkey, replace(replace(o_orderpriority || ' = é', '=', '=3D'), 'é', '=C3=A9') AS quoted, regexp_replace(o_orderpriority || '_x.y', '[^A-Za-z0-9]', '-', 'g') AS file,
  CAST(regexp_extract(o_orderpriority, '^([0-9]+)', 1) AS BIGINT) AS leading, 0 AS none, floor(o_totalprice) + 0.5::DOUBLE AS amount,
  epoch(o_orderdate)::BIGINT AS utc, CASE WHEN month(o_orderdate) IN (1, 2, 5, 6, 7, 8, 11, 12) THEN {_LOCAL} END AS local, epoch(o_orderdate)::BIGINT AS from_rss,
  upper((['zondag', 'maandag', 'dinsdag', 'woensdag', 'donderdag', 'vrijdag', 'zaterdag'])[dayofweek(o_orderdate) + 1][1]) || (['zondag', 'maandag', 'dinsdag', 'woensdag', 'donderdag', 'vrijdag', 'zaterdag'])[dayofweek(o_orderdate) + 1][2:]
    || ' ' || day(o_orderdate) || ' ' || (['januari', 'februari', 'maart', 'april', 'mei', 'juni', 'juli', 'augustus', 'september', 'oktober', 'november', 'december'])[month(o_orderdate)] || ' ' || year(o_orderdate) AS in_words,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') ELSE 'Geen datum' END AS minute, strftime(o_orderdate, '%Y-%m-%d') AS day10,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS titled, substr(md5(o_orderkey::VARCHAR), 1, 8) AS short, o_orderkey % 7 < 2 AS odd FROM orders""")
def scalar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of texts, numbers and dates that pages use, over all orders."""
    priority, even = F.col("o_orderpriority"), F.col("o_orderkey") % 2 == 0
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    plain = ~F.month("o_orderdate").isin(3, 4, 9, 10)  # away from the changes of the clock, which the statement does not know
    seconds = F.when(F.col("o_orderkey") % 7 == 0, -1).when(F.col("o_orderkey") % 7 == 1, 901).otherwise(900)
    c: dict[str, Column] = {
        "quoted": X.quoted_printable(F.concat(priority, F.lit(" = é"))),
        "file": X.file_name(F.concat(priority, F.lit("_x.y"))),
        "leading": X.leading_int(priority),
        "none": X.leading_int(F.lit("x1")).cast("int"),
        "amount": X.leading_double(F.concat(F.floor("o_totalprice").cast("string"), F.lit(".5 euro"))),
        "utc": X.utc_epoch(stamp),
        "local": F.when(plain, X.local_epoch(F.concat(stamp, F.lit("+02:00")))),
        "from_rss": X.rss_epoch(X.rss_date(F.col("o_orderdate"))),
        "in_words": X.long_date(F.col("o_orderdate")),
        "minute": X.date_minute(F.when(even, stamp).otherwise(X.date10(stamp))),
        "day10": X.date10(stamp),
        "titled": X.default_if_empty(F.when(even, "").otherwise(priority), F.col("o_orderstatus")),
        "short": X.short_id(F.md5(F.col("o_orderkey").cast("string").cast("binary"))),
        "odd": X.odd_duration(seconds),
    }
    return table(spark, sf_dir, "orders").select("o_orderkey", *[v.alias(k) for k, v in c.items()])


def _sortable(rows: DataFrame, c: str) -> Column:
    """A column as text of the same order: whole numbers (none below zero) begin with a letter for their number of digits, other text stays."""
    value = F.col(c).cast("string")
    if isinstance(rows.schema[c].dataType, IntegralType):
        value = F.concat(F.chr(F.length(value) + 64), value)
    return F.coalesce(value, F.lit(""))


def with_children(parents: DataFrame, key: str, children: dict[str | tuple[str, ...], tuple[DataFrame, list[str], Column | list[Column]]], once: tuple[str, ...] = ()) -> DataFrame:
    """``parents`` with a list for each kind of child.

    ``children``: by name, rows with the parent's key, the columns that order them, and what the list shows; several
    names with a text each if the same rows are shown in several lists. All kinds become one tagged table of the same
    columns, whose rows are exchanged as they are; one aggregation gathers them in one list, from which each list is
    taken. So lists don't multiply each other, however many there are, and the parents are joined once. Parents without
    children have empty lists. Nulls in what is ordered come first. In the lists named in ``once``, children of equal
    order and text stand once.
    """
    tagged, places = [], {}
    for kind, (names, (rows, order, shown)) in enumerate(children.items()):
        texts = [x.cast("string") for x in (shown if isinstance(shown, list) else [shown])]
        places |= {name: (kind, k) for k, name in enumerate([names] if isinstance(names, str) else names)}
        tagged.append(rows.select(F.col(key), F.struct(F.lit(kind).cast("byte").alias("kind"), F.array(*[_sortable(rows, c) for c in order]).alias("at"), F.array(*texts).alias("shown")).alias("__child")))
    lists = _union(tagged).repartition(key).groupBy(key).agg(F.array_sort(F.collect_list("__child")).alias("__children"))
    every = F.coalesce("__children", F.array().cast(lists.schema["__children"].dataType))
    of = lambda name, kind: (F.array_distinct if name in once else lambda x: x)(F.filter(every, lambda x: x["kind"] == kind))
    text = lambda name, kind, k: F.transform(of(name, kind), lambda x: x["shown"][k])
    return parents.join(lists, key, "left").select(*parents.columns, *[text(name, *place).alias(name) for name, place in places.items()])


@query("""
WITH o AS (SELECT o_orderkey AS doc, o_orderkey::VARCHAR AS nummer, strftime(o_orderdate, '%Y-%m-%d') AS datum, o_orderpriority AS soort, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey - o_orderkey % 8 END AS bron FROM orders),
l AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS zaak FROM lineitem),
e AS (SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M') AS datum FROM events),
actors AS (SELECT l_orderkey AS doc, string_agg(l_returnflag || ' ' || coalesce(s_name, ''), '; ' ORDER BY l_returnflag, coalesce(s_name, '')) AS x FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
annexes AS (SELECT bron AS doc, string_agg(nummer, '; ' ORDER BY nummer::INT) AS x FROM o WHERE bron IS NOT NULL GROUP BY 1),
cases AS (SELECT doc, string_agg(zaak || ' ' || coalesce(p_name, ''), '; ' ORDER BY zaak) AS x, count(*) AS n, min(zaak) AS one FROM l LEFT JOIN part ON p_partkey = zaak GROUP BY 1),
votes AS (SELECT l_orderkey AS doc, string_agg(line, '; ' ORDER BY l_partkey) AS x FROM (SELECT l_orderkey, l_partkey, l_partkey || ' voor ' || count(*) FILTER (WHERE l_linestatus = 'F') || ' tegen ' || count(*) FILTER (WHERE l_linestatus = 'O') AS line FROM lineitem GROUP BY 1, 2) GROUP BY 1),
acts AS (SELECT doc, string_agg(datum || ' ' || event_type, '; ' ORDER BY datum, event_id) AS x FROM (SELECT DISTINCT doc, event_id, event_type, datum FROM (SELECT doc, event_id, event_type, datum FROM l JOIN e ON event_id = zaak UNION ALL SELECT event_id, event_id, event_type, datum FROM e)) GROUP BY 1),
answers AS (SELECT q.doc, string_agg(a.doc::VARCHAR, '; ' ORDER BY a.doc) AS x FROM (SELECT DISTINCT q.doc, a.doc AS other FROM l q JOIN o ON o.doc = q.doc AND soort = '1-URGENT' JOIN l a ON a.zaak = q.zaak) q JOIN o a ON a.doc = other AND a.soort = '2-HIGH' GROUP BY 1)
SELECT o.doc, nummer, datum, soort, coalesce(actors.x, '') AS actors, coalesce(annexes.x, '') AS annexes, coalesce(cases.x, '') AS cases, coalesce(votes.x, '') AS votes, coalesce(acts.x, '') AS activities, coalesce(answers.x, '') AS answers,
  CASE WHEN soort = '1-URGENT' AND cases.n = 1 AND answers.x IS NULL THEN one::VARCHAR ELSE '' END AS open_case
FROM o LEFT JOIN actors USING (doc) LEFT JOIN annexes USING (doc) LEFT JOIN cases USING (doc) LEFT JOIN votes USING (doc) LEFT JOIN acts USING (doc) LEFT JOIN answers USING (doc)""")
def document_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's page: actors by role, annexes, cases, votes, activities (of its cases and its own) by date, answers; and its case if it is a question with one case and no answer."""
    t = lambda name: table(spark, sf_dir, name)
    text = lambda c: F.col(c).cast("string")
    orders = t("orders").select(F.col("o_orderkey").alias("doc"), text("o_orderkey").alias("nummer"), day("o_orderdate").alias("datum"), F.col("o_orderpriority").alias("soort"))
    items = t("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("zaak"), "l_suppkey", "l_returnflag", "l_linestatus")
    of_case = items.groupBy("doc", "zaak").agg(F.count_if(F.col("l_linestatus") == "F").alias("ayes"), F.count_if(F.col("l_linestatus") == "O").alias("noes"))
    actors = items.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey", "left").withColumn("s_name", F.coalesce("s_name", F.lit("")))
    annexes = orders.where("doc % 8 <> 0").select((F.col("doc") - F.col("doc") % 8).alias("doc"), F.col("doc").alias("annex"))
    cases = of_case.join(t("part").select(F.col("p_partkey").alias("zaak"), "p_name"), "zaak", "left")
    events = t("events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"))
    of_cases = of_case.select("doc", F.col("zaak").alias("event_id")).unionByName(events.select(F.col("event_id").alias("doc"), "event_id"))
    questions = of_case.join(orders.where("soort = '1-URGENT'").select("doc"), "doc").select("doc", "zaak")
    answers = of_case.join(orders.where("soort = '2-HIGH'").select("doc"), "doc").select(F.col("doc").alias("answer"), "zaak")
    pages = with_children(orders, "doc", {
        "actors": (actors, ["l_returnflag", "s_name"], F.concat_ws(" ", "l_returnflag", "s_name")),
        "annexes": (annexes, ["annex"], F.col("annex")),
        ("cases", "votes"): (cases, ["zaak"], [F.concat_ws(" ", text("zaak"), F.coalesce("p_name", F.lit(""))), F.concat_ws(" ", text("zaak"), F.lit("voor"), text("ayes"), F.lit("tegen"), text("noes"))]),
        "activities": (of_cases.join(events, "event_id"), ["at", "event_id"], F.concat_ws(" ", "at", "event_type")),
        "answers": (questions.join(answers, "zaak").select("doc", "answer"), ["answer"], F.col("answer")),
    }, once=("activities", "answers"))
    pages = pages.withColumn("votes", F.array_distinct("votes"))  # a case with two names has one line of votes
    alone = (F.col("soort") == "1-URGENT") & (F.size("cases") == 1) & (F.size("answers") == 0)
    pages = pages.withColumn("open_case", F.when(alone, F.split_part(F.get("cases", F.lit(0)), F.lit(" "), F.lit(1))).otherwise(""))
    return pages.select("doc", "nummer", "datum", "soort", *[F.array_join(c, "; ").alias(c) for c in ("actors", "annexes", "cases", "votes", "activities", "answers")], "open_case")
