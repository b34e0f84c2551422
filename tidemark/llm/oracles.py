"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SETS = rf"""
  SELECT DISTINCT %s AS id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s
  FROM (SELECT *, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM %s)"""

CONTAINED = f"""
WITH d AS ({_SETS % ('doc_id', 'documents')}), q AS ({_SETS % ('item_id', 'benchmark')}), n AS (SELECT id, count(*) AS item_shingles FROM q GROUP BY id),
c AS (SELECT d.id AS doc_id, q.id AS item_id, count(*) AS shared FROM d JOIN q ON d.s = q.s GROUP BY 1, 2)
SELECT doc_id, item_id, item_shingles, shared, shared::DOUBLE / item_shingles AS containment FROM c JOIN n ON item_id = id WHERE 4 * shared >= 3 * item_shingles"""

_SETS_3 = _SETS.replace("len(w) >= 5", "len(w) >= 3").replace("len(w) - 3", "len(w) - 1").replace("w[i:i + 4]", "w[i:i + 2]")

_COMPONENTS = """
WITH RECURSIVE d AS (%s), n AS (SELECT id, count(*) AS n FROM d GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM d a JOIN d b ON a.s = b.s AND a.id <> b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * shared >= %d * (x.n + y.n - shared)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM r WHERE a = doc_id), doc_id)) AS component_id FROM documents LEFT JOIN n ON n.id = doc_id"""

COMPONENTS = _COMPONENTS % (_SETS % ("doc_id", "documents"), 75)
KEPT = f"SELECT *, doc_id = component_id AS kept FROM ({_COMPONENTS % (_SETS_3 % ('doc_id', 'documents'), 85)})"

_TABLE = "list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n))"

SHARDS = f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT {_TABLE} AS t),
d AS (SELECT doc_id, octet_length(encode(text))::BIGINT + 1 AS size,
  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT), lambda c, b: xor(c // 256, t.t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM documents, t),
j AS (SELECT doc_id, n, -1::BIGINT AS b, 0::BIGINT AS j, doc_id::HUGEINT AS k FROM (SELECT DISTINCT doc_id FROM documents), (SELECT unnest([8, 9]) AS n)
  UNION ALL SELECT doc_id, n, j, floor((j + 1) * (2147483648::DOUBLE / (((k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1)::DOUBLE))::BIGINT, (k * 2862933555777941757 + 1) % 18446744073709551616 FROM j WHERE j < n),
s AS (SELECT doc_id, max(b) FILTER (WHERE n = 8)::INT AS shard, max(b) FILTER (WHERE n = 9)::INT AS grown_shard FROM j WHERE j >= n GROUP BY 1)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY (doc_id::HUGEINT * 2862933555777941757 + 1) % 18446744073709551616, size, text_crc32) - 1 AS slot, grown_shard
FROM d JOIN s USING (doc_id)"""

DRAWN = rf"""
WITH t AS MATERIALIZED (SELECT {_TABLE} AS t),
f AS (SELECT doc_id, 0 AS target, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents UNION ALL SELECT item_id, 1, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
c AS (SELECT w, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda b: ('0x' || b)::BIGINT), lambda c, b: xor(c // 256, t.t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS b FROM (SELECT DISTINCT w FROM f), t),
n AS (SELECT b, count(*) FILTER (WHERE target = 0) AS s, count(*) FILTER (WHERE target = 1) AS t FROM f JOIN c USING (w) GROUP BY b), z AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM n),
g AS (SELECT b, floor(1000 * ln((n.t + 1)::DOUBLE * (z.s + 10000) / ((n.s + 1)::DOUBLE * (z.t + 10000))))::BIGINT AS gain FROM n, z),
e AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS w FROM f JOIN c USING (w) JOIN g USING (b) WHERE target = 0 GROUP BY 1),
d AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN e USING (doc_id)),
k AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM k WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM k LEFT JOIN r USING (doc_id)"""

AUDIT = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m FROM w),
n AS (SELECT part, m, count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM f GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS v),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.v, b.v, c.v, d.v, e.v] AS v FROM l a, l b, l c, l d, l e WHERE a.v + b.v + c.v + d.v + e.v = 31 AND len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s AS (SELECT filter_order, step, v[step] AS v, coalesce(list_sum(v[1:step - 1]), 0)::BIGINT AS gone FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
o AS (SELECT part, filter_order, step, v, sum(n) FILTER (WHERE m & (gone + v) = 0) AS kept, sum(n) FILTER (WHERE m & gone = 0 AND m & v > 0) AS removed, sum(n) FILTER (WHERE m & gone > 0 AND m & v > 0) AS redundant,
  sum(n) FILTER (WHERE m = v) AS unique_fails, sum(good) FILTER (WHERE m & gone = 0 AND m & v > 0) AS good_lost, sum(toxic) FILTER (WHERE m & gone = 0 AND m & v > 0) AS toxic_lost FROM n, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, v), 0)::BIGINT AS shapley FROM o"""

ORACLES = {"op2_sharding": SHARDS, "op5_ngram_join": COMPONENTS, "op10_decontamination": CONTAINED, "op11_chosen_path": KEPT, "op12_resampling": DRAWN, "op13_filter_audit": AUDIT}
