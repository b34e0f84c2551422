"""Search, linking and text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import linking
from tidemark.operators import relational as R
from tidemark.plans import query
from tidemark.search import engine as S
from tidemark.search.upkeep import read_documents, read_postings, signature, update_index
from tidemark.sources.tables import table
from tidemark.streaming.feed import scratch

_TOK = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}\p{M}_]+')"


def _has(phrase: str) -> str:
    return rf"regexp_matches(strip_accents(lower(text)), '(^|[^\p{{L}}\p{{N}}_]){phrase}([^\p{{L}}\p{{N}}_]|$)')"


#: Where the index of a data directory lies, and which files it was made from, by application and directory.
_STORED: dict[tuple[str, str], tuple[str, tuple]] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the index of the documents; the first query that asks for it builds it, and one that finds other files brings it up to date."""
    key, now = (spark.sparkContext.applicationId, sf_dir), signature(spark, f"{sf_dir}/documents.parquet")
    path, then = _STORED.get(key, (None, None))
    if then != now:
        path = path or scratch(spark)
        update_index(table(spark, sf_dir, "documents"), "doc_id", ["text"], path)
        _STORED[key] = path, now
    return path


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_index(spark, stored_index(spark, sf_dir))


@query(rf"""SELECT doc_id FROM documents WHERE ({_has('eran')} AND {_has('erth')} AND NOT {_has('eror')}) OR {_has('erat[^a-z]+of')} OR {_has('thionth[a-z]*')}""")
def search_boolean(spark: SparkSession, sf_dir: str, typed: str = 'eran AND erth NOT eror OR "erat of" OR thionth*') -> DataFrame:
    """Documents that a query with AND, OR, NOT, a phrase and a prefix matches. Between a phrase's words may stand what has no letter a to z, such as a number."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit("text").alias("col"), "text")
    return S.match(_index(spark, sf_dir), typed, texts=texts).select(F.col("doc").alias("doc_id"))


@query(f"""
WITH t AS (SELECT doc_id, unnest({_TOK}) AS token FROM documents),
d AS (SELECT doc_id, count(*) AS size, count(*) FILTER (WHERE token = 'eran') AS f1, count(*) FILTER (WHERE token = 'erth') AS f2 FROM t GROUP BY 1),
s AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (WHERE f1 > 0) AS n1, count(*) FILTER (WHERE f2 > 0) AS n2 FROM d)
SELECT doc_id, round(-greatest(ln((n - n1 + 0.5::DOUBLE) / (n1 + 0.5::DOUBLE)), 1e-6) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))
  - greatest(ln((n - n2 + 0.5::DOUBLE) / (n2 + 0.5::DOUBLE)), 1e-6) * f2 * 2.2::DOUBLE / (f2 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)), 6) AS score
FROM d, s WHERE f1 > 0 AND f2 > 0""")
def search_bm25(spark: SparkSession, sf_dir: str, typed: str = "eran erth") -> DataFrame:
    """Documents with both words, and their rank, best first."""
    index = _index(spark, sf_dir)
    scored = S.with_score(S.match(index, typed), index, typed, S.read_lengths(spark, stored_index(spark, sf_dir)))
    return scored.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score")).orderBy("score", "doc_id")


@query(f"""
SELECT doc_id, lang, datum FROM (SELECT doc_id, lang, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS datum FROM documents
  WHERE ({_has('the')} OR {_has('la')}) AND lang IN ('en', 'fr', 'es') AND strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') >= '2024-03-01' ORDER BY doc_id DESC LIMIT 280)
WHERE lang <> 'fr'""")
def search_ranked_newest(spark: SparkSession, sf_dir: str, typed: str = "the OR la") -> DataFrame:
    """The newest 280 hits of some categories since a day; the kind is filtered after the limit."""
    datum = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd")
    meta = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("category"), datum.alias("datum"))
    hits = S.search(_index(spark, sf_dir), meta, typed, ["en", "fr", "es"], "2024-03-01", sizes=S.read_lengths(spark, stored_index(spark, sf_dir)))
    return hits.where("category <> 'fr'").select(F.col("doc").alias("doc_id"), F.col("category").alias("lang"), "datum")


@query(rf"""
WITH h AS (SELECT doc_id, text FROM documents WHERE {_has('eran')} AND {_has('erth')} ORDER BY doc_id DESC LIMIT 280),
t AS (SELECT doc_id, string_split_regex(text, '[\p{{L}}\p{{N}}\p{{M}}_]+') AS g, regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{M}}_]+') AS raw FROM h),
f AS (SELECT *, list_transform(raw, lambda x: strip_accents(lower(x)) IN ('eran', 'erth')) AS hit, list_transform(raw, lambda x: strip_accents(lower(x))) AS w FROM t),
p AS (SELECT *, unnest(list_filter(range(1, len(hit) + 1), lambda i: hit[i])) AS start FROM f),
b AS (SELECT doc_id, any_value(g) AS g, any_value(raw) AS raw, any_value(hit) AS hit, arg_min(start, (-len(list_distinct(list_filter(w[start:start + 19], lambda y: y IN ('eran', 'erth')))), start)) AS start FROM p GROUP BY doc_id)
SELECT doc_id, CASE WHEN start > 1 THEN '...' ELSE '' END || list_aggregate(list_transform(range(start, least(start + 20, len(raw) + 1)),
  lambda i: CASE WHEN i > start THEN g[i] ELSE '' END || CASE WHEN hit[i] THEN '<b>' || raw[i] || '</b>' ELSE raw[i] END), 'string_agg', '') || CASE WHEN start + 19 < len(raw) THEN '...' ELSE '' END AS snippet FROM b""")
def search_snippet(spark: SparkSession, sf_dir: str, typed: str = "eran erth") -> DataFrame:
    """The newest hits with the part of the text that shows most of the query."""
    docs = table(spark, sf_dir, "documents")
    hits = S.match(_index(spark, sf_dir), typed).select(F.col("doc").alias("doc_id")).join(docs, "doc_id").orderBy(F.desc("doc_id")).limit(S.LIMIT)
    return hits.select("doc_id", S.snippet(F.col("text"), typed).alias("snippet"))


@query(f"""
WITH t AS (SELECT doc_id, unnest(list_zip({_TOK}, range(len({_TOK})))) AS x FROM documents),
p AS (SELECT doc_id, x[1] AS token, x[2] AS pos FROM t WHERE x[1] IN ('eran', 'erth'))
SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.token = 'eran' AND b.token = 'erth' AND abs(a.pos - b.pos) - 1 <= 5""")
def search_near(spark: SparkSession, sf_dir: str, typed: str = "NEAR(eran erth, 5)") -> DataFrame:
    """Documents in which two words stand near each other."""
    return S.match(_index(spark, sf_dir), typed, raw=True).select(F.col("doc").alias("doc_id"))


@query("""
SELECT conv_id, string_agg(role || ': ' || regexp_replace(text, '<[^>]*>', ' ', 'g'), ' ' ORDER BY turn) AS body, count(*) AS parts FROM conversations GROUP BY conv_id""")
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search documents made of parts in their order, without tags."""
    part = F.struct("turn", F.concat(F.col("role"), F.lit(": "), X.strip_tags(F.col("text"))).alias("body"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("p"), F.count(F.lit(1)).alias("parts"))
    return rows.select("conv_id", F.array_join(F.transform("p", lambda p: p["body"]), " ").alias("body"), "parts")


@query("""
SELECT page_id, regexp_replace(regexp_replace(html, ' style="[^"]*"', '', 'g'), '<[^>]*>', ' ', 'g') AS plain, length(html) AS n FROM pages""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without style attributes and tags."""
    return table(spark, sf_dir, "pages").select("page_id", X.strip_tags(X.strip_styles(F.col("html"))).alias("plain"), F.length("html").cast("long").alias("n"))


@query("""
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '"', '&quot;'), '''', '&apos;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped"))


@query(r"""
SELECT page_id, list_aggregate(list_transform(regexp_extract_all(lower(hex(encode(url))), '..'),
  lambda b: CASE WHEN regexp_matches(chr(('0x' || b)::INTEGER), '^[A-Za-z0-9._~-]$') THEN chr(('0x' || b)::INTEGER) ELSE '%' || b END), 'string_agg', '') AS escaped
FROM pages""")
def url_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.url_escape(F.col("url")).alias("escaped"))


@query(r"""
WITH m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS number FROM documents),
k AS (SELECT number, count(*) AS n, min(doc_id) AS other FROM m GROUP BY 1)
SELECT m.doc_id, m.number FROM m JOIN k USING (number) WHERE n = 1""")
def harvest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers found in texts that lead to exactly one row."""
    docs = table(spark, sf_dir, "documents")
    found = linking.harvest(docs, "doc_id", "text", "[0-9]{4,}")
    return linking.unique_targets(found, found.select(F.col("number"), F.col("doc_id").alias("target")), "number").select("doc_id", "number")


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(160), ' '), '(20[0-9]{2}D[0-9]{5})', '<a href="document.html?nummer=\1">\1</a>', 'g'),
  '(20[0-9]{2}Z[0-9]{5})', '<a href="zaak.html?nummer=\1">\1</a>', 'g') AS linked FROM (
  SELECT doc_id, replace(text, ' the ', ' 2024D' || lpad((doc_id % 90000 + 10000)::VARCHAR, 5, '0') || ' and 2023Z' || lpad((doc_id % 70000 + 10000)::VARCHAR, 5, '0') || ' ') AS text FROM documents)""")
def link_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which document and case numbers become links."""
    number = lambda base: F.lpad((F.col("doc_id") % base + 10000).cast("string"), 5, "0")
    mention = F.concat(F.lit(" 2024D"), number(90000), F.lit(" and 2023Z"), number(70000), F.lit(" "))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" the "), mention).alias("text"))
    return docs.select("doc_id", linking.link_numbers(F.col("text")).alias("linked"))


_PART = linking.DOSSIER.replace("'", "''")
_MOTION = linking.MOTION


@query(rf"""
WITH t AS (SELECT doc_id, 'zie 36 ' || lpad((doc_id % 900 + 100)::VARCHAR, 3, '0') || ', nr. ' || doc_id % 7 || ' en nr. ' || doc_id % 5 || ' (36' || lpad((doc_id % 900 + 50)::VARCHAR, 3, '0') || ') of 3 (36999-VI) ' || text AS body FROM documents),
x AS (SELECT doc_id, unnest(list_zip(string_split_regex(body, '{_PART}'), regexp_extract_all(body, '{_PART}', 0), range(len(string_split_regex(body, '{_PART}'))))) AS z FROM t),
y AS (SELECT doc_id, z[1] AS gap, z[2] AS ref, z[3] AS i, try_cast(regexp_replace(regexp_extract(z[2], '{_PART}', 1), '\s', '', 'g') AS BIGINT) AS nummer, regexp_extract(z[2], '{_PART}', 2) AS suffix, try_cast(regexp_extract(z[2], '{_PART}', 3) AS INT) AS volg FROM x),
k AS (SELECT 36000 + p_partkey % 1000 AS nummer, min(p_partkey) AS document FROM part GROUP BY 1),
r AS (SELECT doc_id, string_agg(gap || CASE WHEN ref IS NULL THEN '' WHEN document IS NULL OR ends_with(gap, 'kst-') THEN ref ELSE '<a href="document.html?nummer=' || document || '">' || ref || '</a>' END, '' ORDER BY i) AS body
  FROM y LEFT JOIN k ON k.nummer = y.nummer AND suffix = '' AND volg = 3 GROUP BY doc_id),
m AS (SELECT doc_id, unnest(list_zip(string_split_regex(body, '{_MOTION}'), regexp_extract_all(body, '{_MOTION}', 0), range(len(string_split_regex(body, '{_MOTION}'))))) AS z FROM r),
n AS (SELECT doc_id, z[1] AS gap, z[2] AS ref, z[3] AS i, try_cast(regexp_extract(z[2], '{_MOTION}', 1) AS INT) AS volg, try_cast(regexp_extract(z[2], '{_MOTION}', 2) AS BIGINT) AS nummer, regexp_extract(z[2], '{_MOTION}', 3) AS suffix FROM m)
SELECT doc_id, string_agg(gap || CASE WHEN ref IS NULL THEN '' WHEN document IS NULL THEN ref ELSE '<a href="document.html?nummer=' || document || '">' || ref || '</a> (#' || (i + 1) || ')' END, '' ORDER BY i) AS linked
FROM n LEFT JOIN k ON k.nummer = n.nummer AND suffix = '' AND volg = 3 GROUP BY doc_id""")
def link_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, behind made-up mentions, in which references to dossier parts and motions become links where the part exists; motions are numbered."""
    text = lambda c: c.cast("string")
    code = lambda plus: F.lpad(text(F.col("doc_id") % 900 + plus), 3, "0")
    mention = F.concat(F.lit("zie 36 "), code(100), F.lit(", nr. "), text(F.col("doc_id") % 7), F.lit(" en nr. "), text(F.col("doc_id") % 5), F.lit(" (36"), code(50), F.lit(") of 3 (36999-VI) "))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(mention, "text").alias("text"))
    known = table(spark, sf_dir, "part").groupBy((F.lit(36000) + F.col("p_partkey") % 1000).alias("nummer")).agg(F.min("p_partkey").alias("document"))
    known = known.select("nummer", F.lit("").alias("toevoeging"), F.lit(3).alias("volgnummer"), "document")
    return linking.link_dossiers(docs, known, "doc_id", "text")


_FINAL = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(text, 'the', 'ten') || ' nieuw' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0"


@query(f"""
WITH t AS (SELECT doc_id, unnest({_TOK}) AS token FROM ({_FINAL})), d AS (SELECT doc_id, count(*) AS tokens FROM t GROUP BY 1)
SELECT token, count(*) AS places, count(DISTINCT doc_id) AS docs, sum(doc_id)::BIGINT AS ids, sum(tokens)::BIGINT AS tokens FROM t JOIN d USING (doc_id) GROUP BY token""")
def index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of an index after three batches: first part of the documents, then all of them, then some changed and others gone."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark)
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat(F.replace("text", F.lit("the"), F.lit("ten")), F.lit(" nieuw"))).otherwise(F.col("text"))
    for batch in (docs.where("doc_id % 3 <> 0"), docs, docs.where("doc_id % 7 <> 0").withColumn("text", changed)):
        update_index(batch, "doc_id", ["text"], path)
    rows = read_postings(spark, path).join(read_documents(spark, path).select("doc", "tokens"), "doc")
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("places"), F.count_distinct("doc").alias("docs"), F.sum("doc").alias("ids"), F.sum("tokens").alias("tokens"))


@query("""
SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS largest,
  count(*) FILTER (WHERE json_extract_string(props, '$.missing') IS NOT NULL) AS with_missing FROM events GROUP BY event_type""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values taken out of JSON texts, with a test for presence."""
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint, missing string").alias("p"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("largest"), F.count("p.missing").alias("with_missing"))


@query("""
SELECT CASE WHEN value <= 1 THEN 1 WHEN value <= 2 THEN 2 WHEN value <= 4 THEN 4 WHEN value <= 8 THEN 8 WHEN value <= 16 THEN 16 WHEN value <= 32 THEN 32 WHEN value <= 64 THEN 64
  WHEN value <= 128 THEN 128 WHEN value <= 256 THEN 256 WHEN value <= 512 THEN 512 WHEN value <= 1024 THEN 1024 ELSE 2048 END AS up_to, count(*) AS n FROM events GROUP BY 1""")
def latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram over powers of two."""
    return table(spark, sf_dir, "events").groupBy(X.latency_bucket(F.col("value")).alias("up_to")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN length(text) % 7 <> n_chars % 7 OR n_chars % 11 = 0 THEN 'wrongsize'
  WHEN substr(sha1(text), 1, 1) = '0' THEN 'wronghash' ELSE 'ok' END AS outcome FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY outcome""")
def hash_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of the size and hash check of every stored document."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("there")), "doc_id", "left")
    outcome = (
        F.when(F.col("there").isNull(), "missing")
        .when((F.length("text") % 7 != F.col("n_chars") % 7) | (F.col("n_chars") % 11 == 0), "wrongsize")
        .when(F.substring(F.sha1(F.encode("text", "UTF-8")), 1, 1) == "0", "wronghash")
        .otherwise("ok")
    )
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT field, count(*) FILTER (WHERE v <> '') AS filled, count(*) AS rows, round(100.0::DOUBLE * count(*) FILTER (WHERE v <> '') / count(*), 2) AS percent, max(length(v)) AS longest FROM (
  SELECT unnest(['event_id', 'user_id', 'event_type', 'props']) AS field, unnest([event_id::VARCHAR, user_id::VARCHAR, event_type, props]) AS v FROM events) GROUP BY field""")
def field_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each field holds something."""
    return R.field_profile(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")).withColumn("longest", F.col("longest").cast("long"))
