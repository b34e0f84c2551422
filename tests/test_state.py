"""State tables, monitors, sources and streams on small fixtures."""

import http.server
import json
import re
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.operators import feeds
from tidemark.operators import monitors as M
from tidemark.operators import relational as R
from tidemark.operators import state as ST
from tidemark.operators.linking import link_dossiers
from tidemark.operators.names import resolve_names
from tidemark.plans import QUERIES
from tidemark.sources import enclosures, feed, publications
from tidemark.streaming.feed import current, daily_counts, read_feed, upsert_stream


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_failures_keep_one_row_and_fixes_leave_the_list(spark):
    reports = spark.createDataFrame([("12345", "Document", "PDF", 1), ("12345", "Document", "PDF", 2)], "id string, kind string, reason string, at long")
    none = spark.createDataFrame([], "id string, how string, success boolean, at long")
    first = ST.conversion_state(reports, none)
    assert rows(first, "id", "failures", "state") == [("12345", 2, "unattempted")]
    fixed = ST.conversion_state(reports, spark.createDataFrame([("12345", "OCR", True, 3)], none.schema))
    assert fixed.where("state = 'unattempted'").count() == 0 and fixed.count() == 1


def test_tombstones_remove_until_a_later_write(spark):
    changes = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 3, True), ("b", 4, False), ("c", 5, False)], "id string, seq long, gone boolean")
    out = ST.apply_changes(None, changes, "id", "seq", F.col("gone"))
    assert rows(out, "id", "seq") == [("b", 4), ("c", 5)]
    late = ST.apply_changes(out, spark.createDataFrame([("b", 2, True)], changes.schema), "id", "seq", F.col("gone"))
    assert rows(late, "id", "seq") == [("b", 4), ("c", 5)]


def test_a_write_older_than_a_tombstone_of_an_earlier_batch_stays_hidden(spark):
    schema = "id string, seq long, gone boolean"
    batches = [[("a", 5, True), ("b", 1, False), ("c", 2, False)], [("a", 3, False), ("b", 2, True), ("c", 2, True)], [("a", 4, False), ("b", 9, False), (None, 1, False)]]
    state = None
    for part in batches:
        state = ST.merge_changes(state, spark.createDataFrame(part, schema), "id", "seq", F.col("gone"))
    assert {tuple(r) for r in ST.visible(state).select("id", "seq").collect()} == {("b", 9), (None, 1)} and state.count() == 4
    assert {tuple(r) for r in ST.apply_changes(state, spark.createDataFrame([("a", 6, False), ("c", 1, False)], schema), "id", "seq", F.col("gone")).select("id", "seq").collect()} == {("a", 6), ("b", 9), (None, 1)}


def test_tables_are_swapped_appended_and_pruned(spark, tmp_path):
    for n in (3, 5):
        ST.materialise(spark.range(n), "swapped_test")
        assert spark.table("swapped_test").count() == n
    spark.sql("DROP VIEW swapped_test")
    for d in ("2024-01-01", "2024-01-20"):
        ST.append(spark.createDataFrame([(1, d)], "id long, day string"), str(tmp_path / "t"), "day")
    kept = spark.read.parquet(str(tmp_path / "t")).withColumn("day", F.col("day").cast("string"))
    assert rows(ST.recent(kept, "day", F.lit("2024-01-21"), 14), "id", "day") == [(1, "2024-01-20")]
    left = ST.without(spark.createDataFrame([(1,), (2,), (None,)], "id long"), spark.createDataFrame([(1,), (1,)], "id long"), "id")
    assert {r[0] for r in left.collect()} == {2, None}


def test_edges_written_after_a_tombstone_survive(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 5), ("d", "a", 9)], "van string, naar string, seq long")
    dead = spark.createDataFrame([("a", 4), ("c", 6)], "id string, seq long")
    assert rows(ST.surviving_edges(edges, dead, "seq"), "van", "naar") == [("d", "a")]


def test_interval_join_by_brute_force(spark):
    import random
    from datetime import datetime, timedelta

    rng, zero = random.Random(4), datetime(2024, 1, 1)
    day = lambda: zero + timedelta(seconds=rng.choice([0, 1, 60, 86_400, 10**6, 10**8]) * rng.random())
    facts = [(k, k % 3, day()) for k in range(200)]
    spans = [(k, k % 3, day(), None if k % 9 == 0 else day()) for k in range(120)]
    spans += [(200, 0, facts[0][2], facts[3][2]), (201, 0, facts[0][2], facts[0][2])]
    want = sorted((f, s) for f, a, at in facts for s, b, begin, end in spans if a == b and begin < at and (end is None or at <= end))
    left = spark.createDataFrame(facts, "f long, k long, at timestamp")
    right = spark.createDataFrame(spans, "s long, k long, begin timestamp, stop timestamp")
    assert rows(R.within_interval(left, right, "k", "at", "begin", "stop"), "f", "s") == want and len(want) > 1000


def test_nearest_by_brute_force(spark):
    import random
    from datetime import datetime, timedelta

    rng, zero = random.Random(7), datetime(2024, 1, 1)
    size = lambda: rng.choice([0.0, -1.0, None, 1.0, 10.0, 100.0, 10 ** (3 * rng.random()), 1000 * rng.random()])
    at = lambda: zero + timedelta(seconds=rng.choice([0, 60, 86_400, 10**6, -(10**6)]) * round(rng.random(), 2))
    left = [(k, rng.choice([1, 1, 1, 2, 3, None]), at() if k % 11 else None, size()) for k in range(400)]
    right = [(k, rng.choice([1, 1, 1, 2, 4, None]), at() if k % 13 else None, size()) for k in range(400)]
    want = []
    for i, k, t, v in left:
        fit = [(abs(t - u) // timedelta(microseconds=1), j) for j, m, u, w in right if k is not None and k == m and t and u and v is not None and w is not None and v * 0.1 < w < v * 10]
        want += [(i, min(fit)[1], min(fit)[0])] if fit else []
    one = spark.createDataFrame(left + left[:20], "i long, k long, t timestamp, v double")
    two = spark.createDataFrame(right, "j long, k long, u timestamp, w double")
    assert rows(R.nearest(one, two, "k", "t", "u", "v", "w", "j"), "i", "j", "gap") == want and len(want) > 70
    assert R.nearest(one, two.where("false"), "k", "t", "u", "v", "w", "j").count() == R.nearest(one.where("false"), two, "k", "t", "u", "v", "w", "j").count() == 0


def test_two_hops_in_blocks(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.choice([0, 0, 0, rng.randrange(20)])) for _ in range(300)] + [(None, 0), (5, None)]
    known = {e for e in edges if None not in e}
    want = sorted({(a, b) for a, m in known for b, n in known if m == n and a != b})
    df = spark.createDataFrame(edges, "s long, m long")
    for block in (1, 7, 1000):
        assert rows(R.two_hops(df, "s", "m", block=block), "a", "b") == want
    some = spark.createDataFrame([(3,), (3,), (999,), (None,)], "s long")
    assert rows(R.two_hops(df, "s", "m", some, block=7), "a", "b") == [p for p in want if p[0] == 3]


def test_two_hops_of_a_crowded_middle(spark):
    edges = spark.range(100_000).select(F.col("id").alias("s"), F.lit(1).alias("m"))
    sizes = R.in_blocks(edges, "s", "m", 1000).groupBy("part").count().agg(F.count("*"), F.max("count")).first()
    assert sizes[0] == 100 and sizes[1] < 1200
    assert R.two_hops(edges, "s", "m", spark.createDataFrame([(7,), (8,)], "s long")).count() == 2 * 99_999


def test_smallest_window_gives_nothing_if_none_is_full(spark):
    df = spark.createDataFrame([("2024-01-01",)], "d string").withColumn("d", F.col("d").cast("date"))
    assert R.smallest_window(df, "d", F.lit("2024-01-02").cast("date"), [3, 6], 2).count() == 0


def test_names_need_a_unique_match(spark):
    people = spark.createDataFrame([(1, "Jan", "van den", "Berg"), (2, "An", "", "Smit"), (3, "An", "", "Smit")], "person long, given string, infix string, surname string")
    who = spark.createDataFrame([("Jan", "Berg van den"), ("An", "Smit"), ("Piet", "X")], "given string, surname string")
    assert {(r["surname"], r["person"]) for r in resolve_names(who, people).collect()} == {("Berg van den", 1), ("Smit", None), ("X", None)}


def test_motions_are_numbered_and_linked_where_they_exist(spark):
    known = spark.createDataFrame([(36100, "", 5, 11), (36100, "VI", 6, 12), (36100, "", 7, 14), (36100, "", 7, 13)], "nummer long, toevoeging string, volgnummer int, document long")
    docs = spark.createDataFrame([(1, "nr. 5 (36100) en 9 (36100) en 6 (36100-VI) en 7 (36100)."), (2, "niets"), (3, None)], "id long, body string")
    link = lambda n, ref: f'<a href="document.html?nummer={n}">{ref}</a>'
    want = [(1, f"nr. {link(11, '5 (36100)')} (#1) en 9 (36100) en {link(12, '6 (36100-VI)')} (#3) en {link(13, '7 (36100)')} (#4)."), (2, "niets"), (3, None)]
    assert sorted(tuple(r) for r in link_dossiers(docs, known, "id", "body").collect()) == want


def test_dossier_references_become_links_where_they_exist(spark):
    docs = spark.createDataFrame([(1, "zie 36 100, nr. 3 en 36100-VI-7, niet kst-36100-3; 12 (36100-VI) en 13 (36100-VI)")], "id long, text string")
    known = spark.createDataFrame([(36100, "", 3, "2024D00001")], "nummer long, toevoeging string, volgnummer int, document string")
    out = link_dossiers(docs, known, "id", "text").first()["linked"]
    assert '<a href="document.html?nummer=2024D00001">36 100, nr. 3</a>' in out and "36100-VI-7" in out and "kst-36100-3" in out
    assert out.endswith("12 (36100-VI) en 13 (36100-VI)")  # known to nobody, so no links


ENTRY = """<entry xmlns="http://www.w3.org/2005/Atom"><title>{id}</title><updated>2024-01-01T00:00:00Z</updated><category term="Document"/>
<link rel="next" href="http://x/feed?skiptoken={token}"/><content><document xmlns="u" xmlns:tk="t" tk:bijgewerkt="2024-01-01" tk:verwijderd="{gone}" tk:contentLength="12">
<nummer>2024D{id}</nummer><volgnummer>7 x</volgnummer><kamerstukdossier ref="k1"/><zaak ref="z1"/><zaak ref="z2"/></document></content></entry>"""


def feed_files(tmp_path):
    page = lambda *e: '<feed xmlns="http://www.w3.org/2005/Atom">' + "".join(e) + "</feed>"
    (tmp_path / "Document--1.xml").write_text(page(ENTRY.format(id="1", token=11, gone="false"), ENTRY.format(id="2", token=12, gone="true")).replace("http://x/feed?skiptoken=12", f"file://{tmp_path}/p2.xml?skiptoken=12"))
    (tmp_path / "p2.xml").write_text(page())


def test_feed_source_and_entities(spark, tmp_path):
    (tmp_path / "Document.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom">' + ENTRY.format(id="1", token=11, gone="false").replace("next", "n") + ENTRY.format(id="2", token=12, gone="true").replace("next", "n") + "</feed>")
    spark.dataSource.register(feed.FeedSource)
    raw = spark.read.format("change_feed").option("url", f"file://{tmp_path}/{{category}}.xml").option("categories", "Document").load()
    parsed = feed.parse_entries(raw).cache()
    table = feed.entity_table(parsed, "Document", {"nummer": "string", "volgnummer": "bigint", "kamerstukdossierId": "string", "titel": "string"})
    assert rows(table, "id", "nummer", "volgnummer", "kamerstukdossierId", "titel", "verwijderd") == [("1", "2024D1", 7, "k1", "", False), ("2", "2024D2", 7, "k1", "", True)]
    assert rows(feed.edges(parsed), "van", "naar", "linkSoort") == [("1", "z1", "Zaak"), ("1", "z2", "Zaak"), ("2", "z1", "Zaak"), ("2", "z2", "Zaak")]
    raw = raw.unionByName(spark.createDataFrame([("Document", "3", 13, "", "u", "<entry"), ("Zaak", "4", 14, "", "u", "<entry><content><zaak id='4'><activiteit ref='a1'/><soort>x</soort></zaak></content></entry>"), ("Document", "5", 15, "", "u", None)], feed.RAW)).cache()
    parsed = feed.parse_entries(raw).cache()
    for entity, columns in (("Document", {"nummer": "string", "volgnummer": "bigint", "kamerstukdossierId": "string", "titel": "string"}), ("Zaak", {"soort": "string", "activiteitId": "string", "nummer": "double"})):
        typed = feed.typed_table(raw, entity, columns)
        assert sorted(map(tuple, typed.collect())) == sorted(map(tuple, feed.entity_table(parsed, entity, columns).collect())) and typed.count() > 0
        plan = typed._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert "Python" not in plan and "InPandas" not in plan
    assert sorted(map(tuple, feed.typed_edges(raw).collect())) == sorted(map(tuple, feed.edges(parsed).collect()))
    assert rows(feed.bad_entries(raw), "id") == [("3",), ("5",)]
    assert ("Document", "nummer", 2, 2, 100.0) in rows(feed.field_use(parsed), "entity", "field", "filled", "entries", "percent")


class FeedServer:
    """Pages of three entries after a token, and the newest token, over HTTP; remembers what was asked."""

    def __init__(self):
        self.newest, self.asked = {}, []
        outer = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                outer.asked.append(self.path)
                kind, _, token = self.path.partition("?")[0][1:].partition("/")
                newest = outer.newest[kind]
                if token == "end":
                    body = f"skiptoken={newest}"
                else:
                    following = range(int(token) + 1, newest + 1)[:3]
                    entries = "".join(ENTRY.format(id=k, token=k, gone="false") for k in following)
                    body = '<feed xmlns="http://www.w3.org/2005/Atom">' + re.sub(r"http://x/feed[?]skiptoken=(\d+)", rf"http://127.0.0.1:{outer.port}/{kind}/\1?skiptoken=\1", entries) + "</feed>"
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *_):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def options(self, **more):
        base = f"http://127.0.0.1:{self.port}/{{category}}"
        return {"url": f"{base}/{{token}}", "end": f"{base}/end", "categories": "Document,Zaak,Leeg", "token": "0", "step": "4"} | more


def test_feed_stream_reads_ranges_of_tokens_in_tasks(spark, tmp_path):
    site = FeedServer()
    site.newest = {"Document": 10, "Zaak": 3, "Leeg": 0}
    reader = feed.FeedSource(site.options()).streamReader(None)
    end = reader.latestOffset()
    assert end == {"Document": 10, "Zaak": 3, "Leeg": 0} and all(p.endswith("/end") for p in site.asked)
    parts = reader.partitions(reader.initialOffset(), end)
    assert [(p.category, p.low, p.high) for p in parts] == [("Document", 0, 4), ("Document", 4, 8), ("Document", 8, 10), ("Zaak", 0, 3)]
    assert [[r[2] for r in reader.read(p)] for p in parts] == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10], [1, 2, 3]] and reader.partitions(end, end) == []
    spark.dataSource.register(feed.FeedSource)
    tokens = lambda df: sorted(r[0] for r in df.select("skiptoken").collect())
    got = spark.read.format("change_feed").options(**site.options()).load()
    assert got.rdd.getNumPartitions() == 4 and tokens(got) == sorted([*range(1, 11), 1, 2, 3])
    for newest in (10, 10, 13):  # the second run has nothing new
        site.newest["Document"] = newest
        stream = spark.readStream.format("change_feed").options(**site.options()).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        query.awaitTermination()
        assert tokens(spark.read.parquet(str(tmp_path / "o"))) == sorted([*range(1, newest + 1), 1, 2, 3])
    with pytest.raises(ValueError, match="end"):
        feed.FeedSource({"url": "x", "categories": "a"}).streamReader(None)


def test_a_reader_never_misses_a_table_that_is_refreshed(spark):
    counts, failed, stop = [], [], threading.Event()
    ST.materialise(spark.range(100), "refreshed_test")

    def read():
        while not stop.is_set():
            try:
                counts.append(spark.table("refreshed_test").count())
            except Exception as error:  # noqa: BLE001
                failed.append(error)

    thread = threading.Thread(target=read)
    thread.start()
    for n in (200, 300, 400, 500):
        ST.materialise(spark.range(n), "refreshed_test", keep=3)
    with pytest.raises(Exception, match="(?i)divi"):
        ST.materialise(spark.range(3).selectExpr("raise_error('division')"), "refreshed_test")
    stop.set()
    thread.join()
    assert failed == [] and set(counts) <= {100, 200, 300, 400, 500} and counts == sorted(counts)
    assert spark.table("refreshed_test").count() == 500
    spark.sql("DROP VIEW refreshed_test")


def test_feed_page_keeps_the_token_of_the_entry_before():
    page = '<feed xmlns="http://www.w3.org/2005/Atom">' + ENTRY.format(id="1", token=11, gone="false") + ENTRY.format(id="2", token=0, gone="false").replace("?skiptoken=0", "") + "</feed>"
    found, following = feed.read_page(page.encode())
    assert [r[2] for r in found] == [11, 11] and found[0][0] == "Document" and following


def test_throttle_takes_parts_of_a_second_into_account(spark):
    seen = [("in", "2024-01-05 00:00:00.250000"), ("in", "2024-01-10 00:00:00.250000"), ("out", "2024-01-05 00:00:00.249999"), ("out", "2024-01-09 00:00:00"), ("late", "2024-01-10 00:00:00.250001"), ("late", "2024-01-10")]
    reports = spark.createDataFrame(seen, "thing string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    now = F.lit("2024-01-10 00:00:00.25").cast("timestamp_ntz")
    assert rows(ST.throttled(reports, "thing", "at", now, 5 * 86400, 2), "thing", "reports") == [("in", 2)]
    assert rows(ST.throttled(reports, "thing", "at", now, 50 * 86400, 2, keep_days=5), "thing", "reports") == [("in", 2)]


def test_hits_are_not_exchanged_and_stay_whole_in_many_parts(spark):
    columns = [F.lit("").alias(c) for c in ("toevoeging", "commissie", "fractie", "query")]
    given = spark.range(40).select("id", F.lit(1).alias("userid"), F.when(F.col("id") % 2 == 0, "OODocumentVerantwoordelijke").otherwise("zaak").alias("soort"), F.lit("n").alias("nummer"), *columns, F.lit("x").alias("verantwoordelijke"), F.lit("2024-01-02").alias("cutoff"))
    docs = spark.range(3000).select(F.col("id").alias("doc"), F.when(F.col("id") % 3 == 0, "2024-01-01").otherwise("2024-01-02").alias("datum"), F.lit("").alias("dossier"), F.lit("").alias("suffix"), F.lit("x").alias("publisher"))
    none = lambda schema: spark.createDataFrame([], schema)
    tables = {
        "document": docs.unionByName(docs.where("doc < 10")), "link": docs.select(F.col("doc").alias("van"), F.lit("n").alias("naar"), F.lit("Zaak").alias("link_soort")), "mention": docs.where("doc < 100").select(F.lit("n").alias("said"), F.col("doc").alias("at_doc")),
        "actor": none("actor_doc long, actor_commissie string, actor_persoon string, relatie string"), "posting": none("at_doc long, token string"),
        "speech": none("meeting long, speaker string, seconds long, datum string"), "commitment": none("commitment long, maker string, of_fractie string, of_commissie string, datum string"),
    }
    found = M.evaluate(given, tables)
    assert found.count() == found.distinct().count() == 40 * 2000
    # No operator above the join with the monitors groups or exchanges hits: their names are made by the topmost projections.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "userid" in line and "doc" in line]


def test_monitors_that_watch_the_same_meet_the_data_once(spark, monkeypatch):
    """40 monitors of two users that watch the same are two rows of the join; before, each made its hits there, and sets of monitors were exchanged as lists of numbers."""
    tables = data(spark)
    given = monitor(spark, soort="OODocumentVerantwoordelijke", verantwoordelijke="RIVM", cutoff="2024-01-01").drop("id", "userid", "nummer")
    given = given.crossJoin(spark.range(1, 41).select("id", (F.col("id") % 2).alias("userid"), F.col("id").cast("string").alias("nummer")))
    given = given.unionByName(monitor(spark, id=50, userid=1, soort="ksd", nummer="36100", toevoeging="VI", cutoff="2024-01-01"))
    assert M.bundles(given).count() == 3
    seen = []
    monkeypatch.setattr(M, "_meet", lambda m, *a, meet=M._meet: (seen.append(m), meet(m, *a))[1])
    hits = M.evaluate(given, tables)
    assert sum(m.count() for m in seen) == 3
    assert rows(hits.where("soort <> 'ksd'"), "monitor", "identifier") == [(n, d) for n in range(1, 41) for d in ("d2", "d3")]
    sent = spark.createDataFrame([(0, "d2"), (9, "d3")], "userid long, identifier string")
    want = rows(M.grouped(M.unsent(hits, sent)), "userid", "monitors", "hits", "first_hit")
    for size in (100, 1):
        monkeypatch.setattr(M, "SETS", size)
        monkeypatch.setattr(M, "BROADCAST_MONITORS", size)
        assert rows(M.told(given, tables, sent), "userid", "monitors", "hits", "first_hit") == want and len(want) == 4


def test_a_run_works_messages_out_from_hits_of_bundles(spark, tmp_path):
    """Ten monitors that watch the same are one row for each hit in what messages are made from; before, that was the log with all their hits."""
    folder, columns = str(tmp_path / "m"), monitor(spark).columns
    given = monitor(spark, soort="OODocumentVerantwoordelijke", verantwoordelijke="RIVM", cutoff="2024-01-01").drop("id").crossJoin(spark.range(1, 11)).select(*columns)
    given = given.unionByName(monitor(spark, id=50, soort="ksd", nummer="36100", toevoeging="VI", cutoff="2024-01-01")).withColumns({"last_run": F.lit(None).cast("long"), "interval": F.lit(None).cast("long")})
    told = M.run(spark, folder, 0, given, data(spark), "2024-01-12", 1000)
    assert spark.read.parquet(f"{folder}/found").count() == 4 and spark.read.parquet(f"{folder}/log").count() == 22
    assert rows(told, "userid", "monitors", "hits", "first_hit") == rows(M.grouped(spark.read.parquet(f"{folder}/log")), "userid", "monitors", "hits", "first_hit")


def test_lists_are_cut_into_pages_without_gathering_a_day(spark, small_dir):
    seen = [("2024-03-01 10:00:00.5", 7, ["a"]), ("2024-03-01 10:00:00.5", 3, ["a", "b"]), ("2024-03-01 09:00:00", 9, ["a", "a"]), ("2024-03-01 10:00:59", 1, ["b"]), ("2024-03-02 00:00:00", 5, ["a", "b"])]
    listed = spark.createDataFrame(seen, "ts string, id int, days array<string>").withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "r": F.struct("id")})
    cut = publications.paged(listed, "ts", ["id"], 2).select("day", "page", F.col("resultaten.id").alias("ids"))
    assert rows(cut, "day", "page", "ids") == [("a", 0, [9, 3]), ("a", 1, [7, 5]), ("b", 0, [3, 1]), ("b", 1, [5])]
    plan = QUERIES["publication_days"](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    gathering = [line for line in plan.splitlines() if "Aggregate [" in line and "collect_list" in line]
    assert gathering and all("page#" in line.split("]")[0] for line in gathering)


def test_publications(spark):
    page = json.dumps({"resultaten": [{"document": {"id": "ab_1", "titel": "t", "mutatiedatumtijd": "m"}, "bestandsType": "pdf"}, {"document": {"id": "cd_1"}}]})
    listed = publications.entries(spark.createDataFrame([(page,)], "json string"))
    assert rows(listed, "id", "titel") == [("ab", "t")]
    detail = json.dumps({"document": {"verantwoordelijke": {"label": "Zaanstad"}, "classificatiecollectie": {"documentsoorten": [{"label": "brief"}]}}, "documentrelaties": [{"relation": "https://x/xy_2", "role": "https://r/hasPart"}], "versies": [{"nummer": 1, "bestanden": [{"bestandsnaam": "f.pdf", "grootte": 5}]}]})
    out = publications.details(spark.createDataFrame([("ab", detail), ("zz", "{}")], "id string, json string"))
    assert rows(out, "id", "bestandsnaam", "grootte", "verantwoordelijke", "documentsoorten", "bronDocument") == [("ab", "f.pdf", 5, "Zaanstad", '["brief"]', "xy"), ("zz", "", 0, "", "[]", "")]
    assert rows(publications.to_fetch(listed, out), "id") == [("ab",)]


def test_a_list_is_read_until_too_much_of_another_day(spark):
    def page(*days):
        return json.dumps({"resultaten": [{"document": {"id": f"{k}_1", "openbaarmakingsdatum": d}} for k, d in enumerate(days)]})

    a, b = "2024-01-01", "2024-01-02"
    pages = [(a, 0, page(a, b, b, a)), (a, 1, page(a, b, b, b, a, b, a)), (a, 2, page(a)), (b, 0, page(b)), (b, 1, json.dumps({"resultaten": []})), (b, 2, page(b))]
    out = publications.of_day(spark.createDataFrame(pages, "day string, page int, json string"))
    assert rows(out, "day", "page", "place") == [(a, 0, k) for k in range(4)] + [(a, 1, k) for k in range(5)] + [(b, 0, 0)]


def test_lists_are_read_by_day_until_the_rule_stops_them(spark, tmp_path):
    a, b, c = "2024-02-28", "2024-02-29", "2024-03-01"

    def save(day, page, *days):
        (tmp_path / f"{day}-{page}.json").write_text(json.dumps({"resultaten": [{"document": {"id": f"{day}.{page}.{k}_1", "openbaarmakingsdatum": d}, "bestandsType": "pdf"} for k, d in enumerate(days)]}))

    for page, days in enumerate([(a, a, b), (a, b, b, b, b, a), (a,)]):  # the third page is beyond the rule
        save(a, page, *days)
    for page, days in enumerate([(b,), (), (b,)]):
        save(b, page, *days)
    save(c, 0, c, c)
    spark.dataSource.register(publications.ListSource)
    load = lambda **more: spark.read.format("publication_list").options(url=f"file://{tmp_path}/{{day}}-{{page}}.json", first=a, last="2024-03-02", **more).load()
    assert rows(load(), "day", "page") == [(a, 0), (a, 1), (b, 0), (b, 1), (c, 0)] and load().rdd.getNumPartitions() == 4
    assert rows(publications.of_day(load()), "day", "page", "place") == [(a, 0, 0), (a, 0, 1), (a, 0, 2), (a, 1, 0), (a, 1, 1), (a, 1, 2), (a, 1, 3), (b, 0, 0), (c, 0, 0), (c, 0, 1)]
    assert rows(load(allowed=0), "day", "page") == [(a, 0), (b, 0), (b, 1), (c, 0)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        (tmp_path / f"{c}-0.json").write_text("no json")  # a day that isn't asked for isn't fetched
        for condition, days in ((f"day = '{b}'", [b]), (f"day < '{c}' AND day >= '{b}'", [b]), (f"day IN ('{a}', '{b}') AND page = 0", [a, b]), ("day > '2024-03-01'", [])):
            assert sorted({r["day"] for r in load(prune="true").where(condition).collect()}) == days
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_reports_and_bad_entries(spark, tmp_path):
    from tidemark.plans.pages import write_report

    write_report(spark.createDataFrame([("a,b", 1)], "id string, n int"), str(tmp_path / "r"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "r")), "id", "n") == [("a,b", "1")]
    raw = spark.createDataFrame([("1", 1, "u", "<entry><content><zaak id='1'/></content></entry>"), ("2", 2, "u", "<entry"), ("3", 3, "u", None)], "id string, skiptoken long, updated string, xml string")
    assert rows(feed.parse_entries(raw), "entity", "id") == [("Zaak", "1"), ("_corrupt", "2"), ("_corrupt", "3")]


def test_transcripts(spark):
    turn = '<woordvoerder><spreker objectid="p1"><voornaam>Jan</voornaam><achternaam>Berg</achternaam></spreker><markeertijdbegin>2024-01-01T10:00:00</markeertijdbegin><markeertijdeind>2024-01-01T10:02:00</markeertijdeind><isvoorzitter>{chair}</isvoorzitter><tekst>Dank <b>u</b>\n wel</tekst></woordvoerder>'
    xml = "<v>" + turn.format(chair="false") + turn.format(chair="true") + "<vraag/><vraag/></v>"
    docs = spark.createDataFrame([("m1", xml), ("m2", "no xml <")], "meeting string, xml string")
    spoken = enclosures.turns(docs)
    assert rows(spoken, "speaker", "text", "chair") == [("p1", "Dank u wel", False), ("p1", "Dank u wel", True)]
    assert "Python" not in spoken._jdf.queryExecution().executedPlan().toString() and rows(enclosures.bad_transcripts(docs), "meeting", "length") == [("m2", 8)]
    nested = "<x:v xmlns:x='u'><x:woordvoerder a='1'><x:spreker objectid='p2'/><x:tekst>een &lt;b&gt; <x:i>twee</x:i></x:tekst><x:interrumpant><x:tekst>nee\u00a0 nee</x:tekst></x:interrumpant></x:woordvoerder></x:v>"
    inside = enclosures.turns(spark.createDataFrame([("m3", nested), ("m4", None), ("m5", ""), ("m6", "<v/>")], docs.schema))
    assert rows(inside, "kind", "speaker", "text", "begin") == [("interrumpant", "", "nee nee", ""), ("woordvoerder", "p2", "een <b> twee", "")]
    assert rows(enclosures.speaking_time(spoken), "meeting", "speaker_seconds", "chair_seconds") == [("m1", 120, 120)]
    assert enclosures.count_elements(docs.where("meeting = 'm1'"), "xml").first()["aantal"] == 2


def test_files_overlay_and_audit(spark, tmp_path):
    for folder, content in (("a", b"abc"), ("b", b"better")):
        (tmp_path / folder / "x").mkdir(parents=True)
        (tmp_path / folder / "x" / "id1").write_bytes(content)
    (tmp_path / "a" / "id2").write_bytes(b"<?xml version='1.0'?><p>hi <i>you</i></p>")
    stored = enclosures.files(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert {r["id"]: bytes(r["content"])[:6] for r in stored.collect()} == {"id1": b"better", "id2": b"<?xml "}
    wanted = spark.createDataFrame([("id1", 6, "0"), ("id2", 1, "0"), ("id3", 1, "0")], "id string, size long, hash string")
    assert rows(enclosures.audit(wanted, stored), "id", "outcome") == [("id1", "wronghash"), ("id2", "wrongsize"), ("id3", "missing")]
    assert dict(rows(enclosures.texts(stored), "id", "text"))["id2"] == "hi you"
    assert rows(enclosures.stored_ids(spark, str(tmp_path / "a")), "id") == [("id1",), ("id2",)]


def monitor(spark, **given):
    base = {"id": 1, "userid": 7, "soort": "", "nummer": "", "toevoeging": "", "commissie": "", "fractie": "", "query": "", "verantwoordelijke": "", "cutoff": "2024-01-10"}
    return spark.createDataFrame([tuple((base | given).values())], "id long, userid long, soort string, nummer string, toevoeging string, commissie string, fractie string, query string, verantwoordelijke string, cutoff string")


def data(spark):
    return {
        "document": spark.createDataFrame([("d1", "2024-01-10", "36100", "VI", "gemeente X"), ("d2", "2024-01-12", "36100", "", "RIVM"), ("d3", "2024-01-01", "36100", "VI", "RIVM")], "doc string, datum string, dossier string, suffix string, publisher string"),
        "link": spark.createDataFrame([("d1", "z1", "Zaak"), ("d2", "a1", "Activiteit")], "van string, naar string, link_soort string"),
        "actor": spark.createDataFrame([("d2", "c1", "p1", "Voortouwcommissie"), ("d1", "c1", "p1", "Gast")], "actor_doc string, actor_commissie string, actor_persoon string, relatie string"),
        "mention": spark.createDataFrame([("d1", "z1"), ("d2", "z1")], "at_doc string, said string"),
        "posting": spark.createDataFrame([("d1", "zorg"), ("d2", "zorg"), ("d2", "wonen")], "at_doc string, token string"),
        "speech": spark.createDataFrame([("m1", "p1", 5, "2024-01-11"), ("m2", "p1", 0, "2024-01-11")], "meeting string, speaker string, seconds int, datum string"),
        "commitment": spark.createDataFrame([("t1", "p1", "VVD", "c1", "2024-01-10"), ("t2", "p1", "D66", "c2", "2024-01-11")], "commitment string, maker string, of_fractie string, of_commissie string, datum string"),
    }


def test_each_kind_of_monitor(spark):
    tables = data(spark)
    hits = lambda **given: [x for (x,) in rows(M.evaluate(monitor(spark, **given), tables), "identifier")]
    assert hits(soort="activiteit", nummer="a1") == ["d2"]
    assert hits(soort="zaak", nummer="z1") == ["d1", "d2"]
    assert hits(soort="ksd", nummer="36100", toevoeging="VI") == ["d1"]
    assert hits(soort="zoek", query="Zorg wonen") == ["d2"] and hits(soort="zoek", query="zorg") == ["d2"]
    assert hits(soort="commissie", commissie="c1") == ["d2"]
    assert hits(soort="persoon", nummer="p1") == ["d1", "d2", "m1", "t2"]
    assert hits(soort="toezeggingen", fractie="VVD") == ["t1"] and hits(soort="toezeggingen") == ["t1", "t2"]
    assert hits(soort="OODocumentVerantwoordelijke", verantwoordelijke="RIVM") == ["d2"]


def test_late_data_is_not_reported_unless_allowed(spark):
    one = monitor(spark, soort="ksd", nummer="36100", toevoeging="VI")
    assert M.evaluate(one, data(spark)).count() == 1 and M.evaluate(one, data(spark), lateness=9).count() == 2


def test_hits_are_sent_once_and_grouped_by_monitors(spark):
    hits = spark.createDataFrame([(7, 1, "zaak", "d1", "x"), (7, 2, "ksd", "d1", "x"), (7, 1, "zaak", "d2", "x"), (8, 3, "zaak", "d2", "x")], "userid long, monitor long, soort string, identifier string, datum string")
    sent = spark.createDataFrame([(7, "d2")], "userid long, identifier string")
    assert rows(M.grouped(M.unsent(hits, sent)), "userid", "monitors", "hits") == [(7, "1,2", 1), (8, "3", 1)]


def _monitors(spark):
    out = monitor(spark, soort="ksd", nummer="36100", toevoeging="VI", cutoff="2024-01-01").unionByName(monitor(spark, id=2, soort="OODocumentVerantwoordelijke", verantwoordelijke="RIVM", cutoff="2024-01-01"))
    return out.withColumns({"last_run": F.lit(None).cast("long"), "interval": F.when(F.col("id") == 2, 100).cast("long")})


@pytest.mark.parametrize("step", ["log", "outbox", "monitors"])
def test_a_run_that_failed_anywhere_is_made_again_and_sends_once(spark, tmp_path, monkeypatch, step):
    from pyspark.sql import DataFrameWriter

    folder, all_ = str(tmp_path / "m"), data(spark)
    seen = lambda day: all_ | {"document": all_["document"].where(F.col("datum") <= day)}
    first = M.run(spark, folder, 0, _monitors(spark), seen("2024-01-10"), "2024-01-10", 1000)
    assert rows(first, "userid", "monitors", "hits") == [(7, "1", 1), (7, "1,2", 1)]
    write = DataFrameWriter.parquet

    def failing(self, path, *a, **b):
        if f"/{step}/run=1" in path:
            raise OSError("lost")
        return write(self, path, *a, **b)

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(DataFrameWriter, "parquet", failing)
        M.run(spark, folder, 1, _monitors(spark), seen("2024-01-12"), "2024-01-12", 1200)
    again = [rows(M.run(spark, folder, 1, _monitors(spark), seen("2024-01-12"), "2024-01-12", 1200), "userid", "monitors", "hits", "message") for _ in range(2)]
    assert again[0] == again[1] and [r[:3] for r in again[0]] == [(7, "2", 1)]
    assert M.run(spark, folder, 2, _monitors(spark), seen("2024-01-12"), "2024-01-12", 1250).count() == 0
    left = rows(spark.read.parquet(f"{folder}/monitors/run=2"), "id", "cutoff", "last_run")
    assert left == [(1, "2024-01-12", 1250), (2, "2024-01-12", 1200)]  # the second waits for its interval
    assert rows(spark.read.parquet(f"{folder}/log"), "run", "identifier") == [(0, "d1"), (0, "d3"), (0, "d3"), (1, "d2")]


def test_monitors_as_a_stream(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "m")
    days = ["2024-01-10", "2024-01-12", "2024-01-13"]
    for k, new in enumerate(([("d1", days[0], "VI")], [("d2", days[1], ""), ("d4", days[1], "VI")], [("d4", days[2], "VI")])):
        spark.createDataFrame([(d, t, "36100", s, "RIVM") for d, t, s in new], "doc string, datum string, dossier string, suffix string, publisher string").coalesce(1).write.mode("append").parquet(str(source))
        M.run_stream(read_feed(spark, str(source)), folder, _monitors(spark), lambda batch: data(spark) | {"document": batch}, lambda n: (days[n], 1000 * (n + 1)), str(tmp_path / "state")).awaitTermination()
        assert (tmp_path / "m" / "outbox" / f"run={k}" / "_SUCCESS").exists()
    assert rows(spark.read.parquet(f"{folder}/log"), "run", "monitor", "identifier") == [(0, 1, "d1"), (0, 2, "d1"), (1, 1, "d4"), (1, 2, "d2"), (1, 2, "d4")]


def test_streamed_upserts_take_empty_batches(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    for part in ([], [("a", 1, False)], [], [("a", 2, True), ("b", 3, False)]):
        spark.createDataFrame(part, "id string, seq long, gone boolean").coalesce(1).write.mode("append").parquet(str(source))
        upsert_stream(read_feed(spark, str(source)), table, str(tmp_path / "state"), "id", "seq", "gone").awaitTermination()
    assert rows(current(spark, table), "id") == [("b",)]


def test_streamed_upserts_survive_a_second_run(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    schema = "id string, seq long, gone boolean"
    for k, part in enumerate(([("a", 1, False), ("b", 2, False)], [("a", 3, True), ("c", 4, False)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        upsert_stream(read_feed(spark, str(source)), table, str(tmp_path / "state"), "id", "seq", "gone").awaitTermination()
        assert rows(current(spark, table), "id") == [[("a",), ("b",)], [("b",), ("c",)]][k]


def test_streamed_upserts_remember_tombstones_and_touch_only_their_buckets(spark, tmp_path):
    from tidemark.streaming.feed import expire

    source, table = tmp_path / "in", str(tmp_path / "table")
    parts = [[(f"k{n}", 1, False) for n in range(200)] + [("x", 5, True)], [("x", 3, False), ("k7", 2, False)], [("k7", 3, True), ("x", 4, False)]]
    for part in parts:
        spark.createDataFrame(part, "id string, seq long, gone boolean").coalesce(1).write.mode("append").parquet(str(source))
        upsert_stream(read_feed(spark, str(source)), table, str(tmp_path / "state"), "id", "seq", "gone").awaitTermination()
    assert rows(current(spark, table), "id") == sorted((f"k{n}",) for n in range(200) if n != 7)
    folders = [len(list((tmp_path / "table" / f"version={k}").glob("bucket=*"))) for k in range(3)]
    assert folders[0] > 20 and folders[1] <= 2 and folders[2] <= 2
    assert expire(spark, table) == folders[1] + folders[2] and rows(current(spark, table), "id") == sorted((f"k{n}",) for n in range(200) if n != 7)


def test_late_events_are_dropped_and_repeats_count_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, "2024-01-01 10:00:00", "a", 1.0), (1, "2024-01-01 10:00:00", "a", 1.0), (2, "2024-01-05 10:00:00", "a", 1.0)], [(3, "2024-01-01 11:00:00", "a", 1.0), (4, "2024-01-09 10:00:00", "a", 1.0)], [(5, "2024-01-20 10:00:00", "a", 1.0)]]
    for part in batches:
        spark.createDataFrame(part, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(source)
        plan = daily_counts(read_feed(spark, source)).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")
        plan.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(out), "day", "n") == [("2024-01-01", 1), ("2024-01-05", 1), ("2024-01-09", 1)]


def test_feed_stream_counts_every_entry_of_files_in_any_order(spark, tmp_path):
    from tidemark.plans import QUERIES

    parts = [[(4, "2024-01-09 10:00:00", "a", 1.0), (5, "2024-01-09 11:00:00", "a", 2.0)], [(1, "2024-01-01 10:00:00", "a", 1.0), (4, "2024-01-09 10:00:00", "a", 1.0)], [(2, "2024-01-05 10:00:00", "b", 4.0), (3, "2024-01-01 09:00:00", "a", 8.0)]]
    for part in parts:
        df = spark.createDataFrame(part, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    out = QUERIES["feed_stream"](spark, str(tmp_path))
    assert rows(out, "day", "event_type", "n", "total") == [("2024-01-01", "a", 2, 9.0), ("2024-01-05", "b", 1, 4.0), ("2024-01-09", "a", 2, 3.0)]


def test_link_dossiers_looks_up_references_in_the_whole_text(spark, tmp_path):
    from tidemark.plans import QUERIES

    tail = "woord " * 60 + "zie 36 105, nr. 3 en 36105-3, niet 36999 3, kst-36105-3 of 36105-VI-3; 7 (36100-VI) en 3 (36105) "
    texts = [(1, tail * 3), (3, "36103-3 " * 40 + tail), (10, "36 110 3"), (11, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k,) for k in range(100, 120)] + [(1105,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))

    def brute(k, t):
        t = f"zie 36 {k % 900 + 100}, nr. {k % 7} en nr. {k % 5} (36{k % 900 + 50:03}) of 3 (36999-VI) " + t

        def dossier(m):
            nummer = int(re.sub(r"\s", "", m[1]))
            known = not m[2] and m[3] == "3" and 36100 <= nummer < 36120 and not t[: m.start()].endswith("kst-")
            return f'<a href="document.html?nummer={nummer - 36000}">{m[0]}</a>' if known else m[0]

        n = iter(range(1, 100))
        linked = re.sub(r"([1234][0-9]{4}|[1234][0-9]\s[0-9]{3})([ -][0-9A-Z]{1,5})?[,nr.\s-]{1,6}([1-9][0-9]{0,3})", dossier, t)

        def motion(m):
            number, nummer = next(n), int(m[2])
            known = m[1] == "3" and not m[3] and 36100 <= nummer < 36120
            return f'<a href="document.html?nummer={nummer - 36000}">{m[0]}</a> (#{number})' if known else m[0]

        return re.sub(r"([1-9]\d{0,3})\s\(([1234]\d{4})(-[0-9A-Z]+)?\)", motion, linked)

    want = [(k, brute(k, t)) for k, t in texts]
    assert want[0][1].count("<a ") == 9 and rows(QUERIES["link_dossiers"](spark, str(tmp_path)), "doc_id", "linked") == want


def test_zoek_monitors_search_as_the_search_does(spark):
    from test_search import QUERIES, TEXTS

    from tidemark.search import engine as S

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc long, tekst string")
    index = S.build_index(docs, "doc", ["tekst"]).cache()
    document = docs.select(F.col("doc").cast("string").alias("doc"), F.lit("").alias("datum"), F.lit("").alias("dossier"), F.lit("").alias("suffix"), F.lit(None).cast("string").alias("publisher"))
    tables = data(spark) | {"document": document, "posting": index.withColumnRenamed("doc", "at_doc").withColumn("at_doc", F.col("at_doc").cast("string"))}
    typed = [*QUERIES, "Café, zaken", "AND"]
    given = monitor(spark, soort="zoek").drop("id", "query").crossJoin(spark.createDataFrame(list(enumerate(typed)), "id long, query string"))
    got = rows(M.evaluate(given, tables), "monitor", "identifier")
    want = [(k, str(r["doc"])) for k, q in enumerate(typed) if q != "AND" for r in S.match(index, q, raw=q in QUERIES).collect()]
    assert got == sorted(want) and len(want) > 60


def test_feeds_are_escaped_ordered_and_complete(spark):
    schema = "feed string, at timestamp, nummer long, onderwerp string, titel string, naam string, bijgewerkt timestamp"
    day = lambda n: __import__("datetime").datetime(2024, 3, n)
    docs = [("a", day(1), 3, "x <b> & y", "T", None, day(1)), ("a", day(1), 2, None, None, "N", day(1)), ("a", day(4), 9, "z", "T", "N", day(5))]
    items = feeds.items(spark.createDataFrame(docs + docs[:1], schema), F.col("feed"), F.col("at"))
    assert rows(items, "title", "description", "guid") == [("", "N |  ", "record_2"), ("x <b> & y", " | T x <b> & y", "record_3"), ("z", "N | T z", "record_9")]
    every = spark.createDataFrame([("a", "A&B", "about"), ("none", "N", "")], "feed string, title string, about string")
    out = {r["feed"]: r for r in feeds.channels(items, every, "https://example.org/", F.lit("2024-01-01").cast("timestamp")).collect()}
    from xml.etree import ElementTree

    full, empty = [ElementTree.fromstring(out[f]["xml"].encode()) for f in ("a", "none")]
    assert [g.text for g in full.iter("guid")] == ["record_9", "record_2", "record_3"] and full.find("channel/title").text == "A&B"
    assert full.find("channel/lastBuildDate").text == "Tue, 05 Mar 2024 00:00:00 GMT" and full.findall(".//item/title")[2].text == "x <b> & y"
    assert out["none"]["items"] == 0 and empty.find("channel/pubDate").text == "Mon, 01 Jan 2024 00:00:00 GMT" and empty.find("channel/lastBuildDate") is None


def test_hits_are_described_by_category(spark):
    t = lambda data, schema: spark.createDataFrame(data, schema)
    tables = {
        "Document": t([(1, "subject"), (2, None)], "nummer long, onderwerp string"),
        "Verslag": t([(1, "plenary")], "nummer long, titel string"),
        "Activiteit": t([(1, "Debat", "over x", "2024-01-02T10:00"), (2, "Debat", None, None), (3, "Debat", "y", "2024")], "nummer long, soort string, onderwerp string, datum string"),
        "PersoonGeschenk": t([(1, "Jan", "", "Berg", "vaas")], "nummer long, roepnaam string, tussenvoegsel string, achternaam string, omschrijving string"),
        "Toezegging": t([(1, "M", "BZK", "doet iets")], "nummer long, naam string, ministerie string, tekst string"),
    }
    hits = t([(c, n, 0) for c in (*tables, "Other") for n in (1, 2, 3)] + [("Document", 1, 0), (None, 1, 0)], "category string, nummer long, more int")
    got = {(r["category"], r["nummer"]): r["description"] for r in feeds.described(hits, tables).collect()}
    want = {("Document", 1): "subject", ("Verslag", 1): "plenary", ("Activiteit", 1): "Debat over x (2024-01-02 10:00)", ("Activiteit", 2): " (nog geen datum)", ("Activiteit", 3): "Debat y (2024)"}
    want |= {("PersoonGeschenk", 1): "Geschenk aan Jan  Berg: vaas", ("Toezegging", 1): "Toezegging van M (BZK): doet iets"}
    want |= {("Other", n): None for n in (1, 2, 3)}
    assert got == {(c, n): "" for c in tables for n in (1, 2, 3)} | want | {(None, 1): None}
    with pytest.raises(ValueError):
        feeds.described(hits, {"Other": tables["Document"]})
