"""Cases, decisions, dossiers and agendas, shown on orders, line items, parts and suppliers."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import relational as R
from tidemark.operators.state import materialise
from tidemark.plans import ORACLES, query
from tidemark.sources.tables import table


def day(name: str):
    return F.date_format(name, "yyyy-MM-dd")


def newest(df: DataFrame, column: str, as_of=None):
    """The clock of a query: a given value, else the newest value in the data (one aggregate row)."""
    return as_of or df.agg(F.max(column)).first()[0]


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS started, o_orderpriority,
  count(*) FILTER (WHERE l_returnflag = 'R') AS n_questions, count(*) FILTER (WHERE l_returnflag = 'A') AS n_answers,
  count(*) FILTER (WHERE l_returnflag = 'N' AND p_type ILIKE '%steel%') AS n_delays, max(p_brand) AS last_brand
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey
WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 5 YEAR
GROUP BY ALL HAVING n_questions > 0 AND n_answers = 0""")
def open_cases(spark: SparkSession, sf_dir: str, as_of=None) -> DataFrame:
    """Cases of the last five years with a question and no answer."""
    orders = table(spark, sf_dir, "orders")
    since = F.lit(newest(orders, "o_orderdate", as_of)) - F.expr("INTERVAL 5 YEARS")
    rows = orders.where(F.col("o_orderdate") > since).join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = rows.groupBy("o_orderkey", day("o_orderdate").alias("started"), "o_orderpriority").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("n_questions"),
        F.count_if(F.col("l_returnflag") == "A").alias("n_answers"),
        F.count_if((F.col("l_returnflag") == "N") & F.col("p_type").ilike("%steel%")).alias("n_delays"),
        F.max("p_brand").alias("last_brand"),
    )
    return counts.where("n_questions > 0 AND n_answers = 0")


@query(ORACLES["open_cases"])
def open_cases_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open cases as a table that is kept: a new version is written and shown in place of the older one, then read."""
    name = f"open_cases_{zlib.crc32(sf_dir.encode()):08x}"
    materialise(open_cases(spark, sf_dir), name)
    return spark.table(name)


@query("""
WITH j AS (
  SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus, coalesce(s_name, '') AS lead_actor,
    row_number() OVER (PARTITION BY o_orderkey ORDER BY l_suppkey DESC NULLS LAST) AS rn
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' LEFT JOIN supplier ON l_suppkey = s_suppkey
  WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY AND o_orderstatus IN ('F', 'O'))
SELECT o_orderkey, day, o_orderstatus, lead_actor FROM j WHERE rn = 1""")
def recent_cases_lead_actor(spark: SparkSession, sf_dir: str, days: int = 365, statuses: tuple[str, ...] | None = ("F", "O"), as_of=None) -> DataFrame:
    """Recent cases with their leading actor, if any; the role stands in the join condition; one row for each case."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    recent = orders.where(F.col("o_orderdate") >= F.lit(newest(orders, "o_orderdate", as_of)) - F.expr(f"INTERVAL {days} DAYS"))
    if statuses:
        recent = recent.where(F.col("o_orderstatus").isin(*statuses))
    lead = recent.join(items, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_returnflag") == "R"), "left")
    lead = lead.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    first = R.first_per(lead, ["o_orderkey"], [F.desc_nulls_last("l_suppkey")])
    return first.select("o_orderkey", day("o_orderdate").alias("day"), "o_orderstatus", F.coalesce("s_name", F.lit("")).alias("lead_actor"))


@query("""
SELECT l_orderkey, bool_or(l_quantity > 49) AS roll_call,
  CASE WHEN bool_or(l_quantity > 49) THEN count(*) FILTER (WHERE l_returnflag = 'A') ELSE coalesce(sum(l_linenumber) FILTER (WHERE l_returnflag = 'A'), 0)::BIGINT END AS n_for,
  CASE WHEN bool_or(l_quantity > 49) THEN count(*) FILTER (WHERE l_returnflag = 'R') ELSE coalesce(sum(l_linenumber) FILTER (WHERE l_returnflag = 'R'), 0)::BIGINT END AS n_against,
  CASE WHEN bool_or(l_quantity > 49) THEN count(*) FILTER (WHERE l_returnflag = 'N') ELSE coalesce(sum(l_linenumber) FILTER (WHERE l_returnflag = 'N'), 0)::BIGINT END AS n_absent,
  coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN l_quantity > 49 THEN s_name ELSE l_linestatus END) FILTER (WHERE l_returnflag = 'A')), ','), '') AS who_for,
  coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN l_quantity > 49 THEN s_name ELSE l_linestatus END) FILTER (WHERE l_returnflag = 'R')), ','), '') AS who_against,
  coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN l_quantity > 49 THEN s_name ELSE l_linestatus END) FILTER (WHERE l_returnflag = 'N')), ','), '') AS who_absent
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey""")
def vote_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of every decision: heads in a roll call, else weights; with who voted how."""
    votes = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return R.tally(votes, ["l_orderkey"], "l_returnflag", {"A": "for", "R": "against", "N": "absent"}, "s_name", "l_linenumber", "l_linestatus", F.col("l_quantity") > 49)


@query("""
WITH a AS (SELECT *, date_diff('day', o_orderdate::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) AS age FROM orders),
c AS (SELECT count(*) FILTER (WHERE age BETWEEN 0 AND 1) d1, count(*) FILTER (WHERE age BETWEEN 0 AND 7) d7, count(*) FILTER (WHERE age BETWEEN 0 AND 84) d84 FROM a),
w AS (SELECT CASE WHEN d1 >= 30 THEN 1 WHEN d7 >= 30 THEN 7 WHEN d84 >= 30 THEN 84 END AS window_days FROM c)
SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day, window_days FROM a, w WHERE age BETWEEN 0 AND window_days""")
def decision_votes_window(spark: SparkSession, sf_dir: str, days: tuple[int, ...] = (1, 7, 84), least: int = 30, as_of=None) -> DataFrame:
    """Decisions of the shortest of three windows that holds enough of them."""
    orders = table(spark, sf_dir, "orders")
    rows = R.smallest_window(orders, "o_orderdate", F.lit(newest(orders, "o_orderdate", as_of)).cast("date"), list(days), least)
    return rows.select("o_orderkey", "o_orderstatus", day("o_orderdate").alias("day"), "window_days")


@query("""
SELECT facet, value, count(*) AS n FROM (
  SELECT 'status' AS facet, o_orderstatus AS value FROM orders WHERE o_orderpriority <> '5-LOW'
  UNION ALL SELECT 'priority', o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'
  UNION ALL SELECT 'segment', c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> '5-LOW')
WHERE value <> '' GROUP BY facet, value""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of open cases by three facets, as one table."""
    rows = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return R.facets(rows, {"status": "o_orderstatus", "priority": "o_orderpriority", "segment": "c_mktsegment"})


@query("""
WITH t AS (SELECT p_partkey, p_retailprice, list_sort(list_distinct(list_transform(list_filter(string_split(p_type, ' '), lambda x: x <> ''), lambda x: replace(lower(x), 'anodized', 'coated')))) AS targets FROM part)
SELECT target, count(*) AS n, round(avg(p_retailprice), 2) AS mean_price, min(array_to_string(targets, ' | ')) AS first_group
FROM (SELECT *, unnest(targets) AS target FROM t) GROUP BY target""")
def multi_value_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by the normalised values of a column with several of them, each once a row."""
    targets = F.filter(F.split("p_type", " "), lambda x: x != "")
    targets = F.array_sort(F.array_distinct(F.transform(targets, lambda x: F.replace(F.lower(x), F.lit("anodized"), F.lit("coated")))))
    rows = table(spark, sf_dir, "part").select("p_retailprice", F.array_join(targets, " | ").alias("group"), F.explode(targets).alias("target"))
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 2).alias("mean_price"), F.min("group").alias("first_group"))


@query("""
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE n_r > 0 AND n_n = 0) AS late_without_extension, sum(n_r)::BIGINT AS questions,
  count(*) FILTER (WHERE n_r > 1) AS several
FROM (SELECT o_orderkey, o_orderpriority, count(l_orderkey) FILTER (WHERE l_returnflag = 'R') n_r, count(l_orderkey) FILTER (WHERE l_returnflag = 'N') n_n
      FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) GROUP BY 1""")
def late_without_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counters over cases: late ones without a postponement, questions in all."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = rows.groupBy("o_orderkey", "o_orderpriority").agg(F.count_if(F.col("l_returnflag") == "R").alias("n_r"), F.count_if(F.col("l_returnflag") == "N").alias("n_n"))
    return per.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("n_r") > 0) & (F.col("n_n") == 0)).alias("late_without_extension"),
        F.sum("n_r").alias("questions"), F.count_if(F.col("n_r") > 1).alias("several"),
    )


@query("""
SELECT doc_id, replace(source, 'src', 'source ') AS source, lang, substr(text, 1, 40) AS head FROM documents
WHERE (lang = 'de' OR source = 'src3' OR text ILIKE 'the %') ORDER BY doc_id DESC LIMIT 300""")
def dynamic_selector(spark: SparkSession, sf_dir: str, want: tuple[str, ...] = ("german", "third", "the"), limit: int = 300) -> DataFrame:
    """Publications that fulfil any of the wanted conditions, newest first; no condition wants nothing."""
    known = {"german": F.col("lang") == "de", "third": F.col("source") == "src3", "the": X.like_ci(F.col("text"), "the %"), "long": F.col("n_chars") > 10_000}
    rows = table(spark, sf_dir, "documents").where(R.any_of([known[w] for w in want]))
    return rows.select("doc_id", F.replace("source", F.lit("src"), F.lit("source ")).alias("source"), "lang", F.substring("text", 1, 40).alias("head")).orderBy(F.desc("doc_id")).limit(limit)


@query("SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 're') ORDER BY p_name LIMIT 100")
def autocomplete(spark: SparkSession, sf_dir: str, typed: str = "RE", limit: int = 100) -> DataFrame:
    """Names that hold what was typed, in either case, the first by name."""
    return table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit(typed.lower()))).select("p_name").distinct().orderBy("p_name").limit(limit)


@query("""
SELECT 'member' AS kind, c_custkey AS id, c_name AS name, n_name AS party FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0
UNION ALL SELECT 'vacancy', s_suppkey, '', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 0""")
def members_and_vacancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitting members and vacant seats in one list."""
    nation = table(spark, sf_dir, "nation")
    members = table(spark, sf_dir, "customer").where("c_acctbal >= 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    vacant = table(spark, sf_dir, "supplier").where("s_acctbal < 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    members = members.select(F.lit("member").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("party"))
    return members.unionByName(vacant.select(F.lit("vacancy").alias("kind"), F.col("s_suppkey").alias("id"), F.lit("").alias("name"), F.col("n_name").alias("party")))


@query("""
SELECT 'region' AS kind, r_name AS committee, n_name AS activity FROM region JOIN nation ON n_name ILIKE '%' || substr(r_name, 1, 2) || '%'
UNION ALL SELECT 'segment', r_name, c_mktsegment FROM region JOIN (SELECT DISTINCT c_mktsegment FROM customer) c ON c_mktsegment ILIKE '%' || substr(r_name, 2, 1) || '%'""")
def committee_activities_like_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists joined where one name is like a pattern made of the other; the pattern side is a catalogue of a few rows."""
    region = table(spark, sf_dir, "region")
    one = region.join(table(spark, sf_dir, "nation"), F.expr("n_name ILIKE concat('%', substring(r_name, 1, 2), '%')"))
    segments = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    two = segments.join(F.broadcast(region), F.expr("c_mktsegment ILIKE concat('%', substring(r_name, 2, 1), '%')"))
    one = one.select(F.lit("region").alias("kind"), F.col("r_name").alias("committee"), F.col("n_name").alias("activity"))
    return one.unionByName(two.select(F.lit("segment").alias("kind"), F.col("r_name").alias("committee"), F.col("c_mktsegment").alias("activity")))


@query("""
SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey
WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R'""")
def two_hop_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are two edges apart: both stand with one case."""
    edges = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", "l_orderkey").distinct()
    return R.two_hops(edges, "l_suppkey", "l_orderkey")


@query("""
SELECT s_suppkey AS id, 'out' AS direction, l_orderkey AS other FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE s_acctbal < 2000 AND l_linestatus = 'F'
UNION SELECT s_suppkey, 'in', l_orderkey FROM supplier JOIN lineitem ON s_suppkey = l_partkey WHERE s_acctbal < 2000 AND l_linestatus = 'O'""")
def edge_both_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an entity is linked to as either end of an edge."""
    entity, edges = table(spark, sf_dir, "supplier").where("s_acctbal < 2000").select("s_suppkey"), table(spark, sf_dir, "lineitem")
    out = entity.join(edges.where("l_linestatus = 'F'"), F.col("s_suppkey") == F.col("l_suppkey")).withColumn("direction", F.lit("out"))
    into = entity.join(edges.where("l_linestatus = 'O'"), F.col("s_suppkey") == F.col("l_partkey")).withColumn("direction", F.lit("in"))
    return out.unionByName(into).select(F.col("s_suppkey").alias("id"), "direction", F.col("l_orderkey").alias("other")).distinct()


@query("""
SELECT doc_id, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS day FROM documents
WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])erat([^a-z0-9_]|$)') AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def mentions_minus_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that mention a term, without those that are known to be linked."""
    hits = table(spark, sf_dir, "documents").where(F.lower("text").rlike("(^|[^a-z0-9_])erat([^a-z0-9_]|$)"))
    fresh = hits.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return fresh.select("doc_id", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd").alias("day"))


@query("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def entries_without_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that have no detail row yet."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id AS id FROM documents EXCEPT (SELECT doc_id FROM labels UNION SELECT conv_id FROM conversations UNION SELECT page_id FROM pages)")
def orphan_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that exist as files but in none of the tables."""
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    known = known.unionByName(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"))).unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).distinct().join(known.distinct(), "id", "left_anti")


@query("""
SELECT strftime(o_orderdate, '%Y') AS year, CASE WHEN month(o_orderdate) <= 6 THEN 'H1' ELSE 'H2' END AS half, strftime(o_orderdate, '%Y-%m') AS month,
  'https://example.org/case.html?number=' || o_orderkey AS line
FROM orders WHERE o_orderpriority ILIKE '1-%' GROUP BY ALL""")
def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the site maps by year, half-year and month, each once."""
    rows = table(spark, sf_dir, "orders").where(X.like_ci(F.col("o_orderpriority"), "1-%"))
    half = F.when(F.month("o_orderdate") <= 6, "H1").otherwise("H2")
    line = F.format_string("https://example.org/case.html?number=%d", "o_orderkey")
    return rows.select(F.date_format("o_orderdate", "yyyy").alias("year"), half.alias("half"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), line.alias("line")).distinct()


@query("""
SELECT n_name AS committee, n_regionkey, max(strftime(o_orderdate, '%Y-%m-%d')) AS last_day, max(strftime(o_orderdate, '%Y-%m-%d')) > '2001-07-25' AS active
FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY n_name, n_regionkey""")
def last_activity_per_committee(spark: SparkSession, sf_dir: str, since: str = "2001-07-25") -> DataFrame:
    """Last day on which each committee did something, and whether that is recent."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    last = rows.groupBy(F.col("n_name").alias("committee"), "n_regionkey").agg(F.max(day("o_orderdate")).alias("last_day"))
    return last.withColumn("active", F.col("last_day") > since)


@query("""
SELECT p_partkey, p_name, max(strftime(l_shipdate, '%Y-%m-%d')) AS last_day, count(*) AS n FROM part JOIN lineitem ON p_partkey = l_partkey
GROUP BY p_partkey, p_name ORDER BY last_day DESC, p_partkey LIMIT 250""")
def top_dossiers(spark: SparkSession, sf_dir: str, limit: int = 250) -> DataFrame:
    """Dossiers with the newest documents."""
    rows = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem"), F.col("p_partkey") == F.col("l_partkey"))
    last = rows.groupBy("p_partkey", "p_name").agg(F.max(day("l_shipdate")).alias("last_day"), F.count(F.lit(1)).alias("n"))
    return last.orderBy(F.desc("last_day"), "p_partkey").limit(limit)


@query("""
WITH r AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, coalesce(c_mktsegment, '') AS committee FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 34 DAY),
t AS (SELECT *, row_number() OVER (PARTITION BY committee, day >= (SELECT strftime(max(o_orderdate) - INTERVAL 30 DAY, '%Y-%m-%d') FROM orders) ORDER BY day, o_orderkey) = 1
  AND day >= (SELECT strftime(max(o_orderdate) - INTERVAL 30 DAY, '%Y-%m-%d') FROM orders) AS today FROM r)
SELECT * FROM t""")
def activities_with_marker(spark: SparkSession, sf_dir: str, as_of=None) -> DataFrame:
    """Planned activities from four days ago on; the first of each committee that is not past is marked."""
    orders = table(spark, sf_dir, "orders")
    now = F.lit(newest(orders, "o_orderdate", as_of)) - F.expr("INTERVAL 30 DAYS")
    rows = orders.where(F.col("o_orderdate") >= now - F.expr("INTERVAL 4 DAYS")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.select("o_orderkey", day("o_orderdate").alias("day"), F.coalesce("c_mktsegment", F.lit("")).alias("committee"))
    rows = rows.withColumn("ahead", F.col("day") >= F.date_format(now, "yyyy-MM-dd"))
    rows = R.ranked(rows, ["committee", "ahead"], [F.asc("day"), F.asc("o_orderkey")])
    return rows.select("o_orderkey", "day", "committee", ((F.col("rank_in_group") == 1) & F.col("ahead")).alias("today"))


@query("""
SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n_items,
  coalesce('[' || string_agg('"' || l_partkey || ':' || l_returnflag || '"', ',' ORDER BY l_partkey, l_returnflag) || ']', '[]') AS items,
  coalesce(max_by(l_returnflag, strftime(l_shipdate, '%Y-%m-%d') || l_returnflag), '') AS outcome
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def nested_case_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case with its parts as one JSON array, and the text of its last decision, in one join."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    part = F.when(F.col("l_orderkey").isNotNull(), F.struct("l_partkey", "l_returnflag"))
    pages = rows.groupBy("o_orderkey", "o_orderstatus").agg(
        F.count("l_orderkey").alias("n_items"), F.array_sort(F.collect_list(part)).alias("parts"),
        F.coalesce(F.max_by("l_returnflag", F.concat(day("l_shipdate"), F.col("l_returnflag"))), F.lit("")).alias("outcome"),
    )
    items = F.to_json(F.transform("parts", lambda p: F.concat_ws(":", p["l_partkey"].cast("string"), p["l_returnflag"])))
    return pages.select("o_orderkey", "o_orderstatus", "n_items", items.alias("items"), "outcome")
