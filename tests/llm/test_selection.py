"""The chosen-path join, the resampling and the filter audit against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from oracle import connect, differences

from tidemark.llm import chosen_path, filter_audit, queries, resample
from tidemark.llm.common import utf8

SCHEMA = "doc_id long, text string, lang string, rank int, kept string, component string, node int, part int, score double, `row` int, weight int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang, 1, "k", "c", 2, 3, 0.5, 4, 5) for i, t, lang in rows], SCHEMA).repartition(parts)


ODD = [
    (1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "a b", "de"), (4, "a b", "de"), (5, "A  b", None), (6, "x" * 30_000, "en"), (7, "word " * 4_000, "en"), (None, "an orphan without an id, but with some text", "en"),
    (None, "an orphan without an id, but with some text", "en"), (8, "é🎉 token = ÀB ½ c#", "fr"), (9, "die straße " * 50, ""), (9, "same id, other text", "de"), (-5, "a b", "de"), (10, "x" * 400_000 + " y" * 100_000, "en"),
]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 3]) for k in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} - {()}


def components_by_hand(rows, percent=85):
    """Union of all documents with an id whose sets are similar, by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows]
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    where = {}
    for k, (i, s) in enumerate(sets):
        for x in s if i is not None else ():
            where.setdefault(x, []).append(k)
    for a, b in {(a, b) for v in where.values() for n, a in enumerate(v) for b in v[n + 1 :]}:
        (i, s), (j, t) = sets[a], sets[b]
        if 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((root(i), root(j)))
            above[y] = x
    return Counter((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in sets)


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_survival_of_a_pair_falls_slowly_and_trees_make_up_for_it():
    assert chosen_path.survival(85, 1) == pytest.approx(1 - (0.14 / 0.17 * 0.15 + 0.03 / 0.17 * 0.15**2)) and chosen_path.survival(85, 3) > 0.68
    assert (1 - chosen_path.survival(85, 3)) ** chosen_path.trees(85, 0.99999) <= 1e-5
    assert chosen_path.trees(95, 0.99999) <= chosen_path.trees(75, 0.99999)


def test_odd_rows_of_the_join(spark):
    rows = [(i, t) for i, t, _ in ODD]
    assert result(chosen_path.deduplicate(frame(spark, ODD))) == components_by_hand(rows)
    assert chosen_path.deduplicate(frame(spark, [])).count() == 0


def edited(rng, words, share):
    out = list(words)
    for k in rng.sample(range(len(out)), int(share * len(out))):
        out[k] = f"new{rng.randrange(10**9)}"
    return out


def test_links_of_all_similarities_and_large_groups(spark):
    """Near and not so near copies in groups of 2 to 300, and texts with a long passage in common that are not similar."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows = []
    for size in (2, 3, 10, 60, 300):
        for share in (0.01, 0.025, 0.035, 0.06):
            base = [rng.choice(vocabulary) for _ in range(rng.choice((120, 300)))]
            rows += [" ".join(base)] + [" ".join(edited(rng, base, share)) for _ in range(size - 1)]
    passage = [rng.choice(vocabulary) for _ in range(200)]
    rows += [" ".join(passage + [rng.choice(vocabulary) for _ in range(60)]) for _ in range(300)]
    rows = list(enumerate(rng.sample(rows, len(rows))))
    assert result(chosen_path.deduplicate(frame(spark, [(i, t, "en") for i, t in rows]))) == components_by_hand(rows)


def test_what_stays_large_is_compared_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    rows = list(enumerate(" ".join(edited(rng, base, share)) for share in (0.02, 0.05, 0.04, 0.08) for _ in range(40)))
    for name, value in (("SMALL", 4), ("DEPTH", 1), ("PART", 8), ("COLUMNS", 64), ("BLOCKED", 20)):
        monkeypatch.setattr(chosen_path, name, value)
    assert result(chosen_path.deduplicate(frame(spark, [(i, t, "en") for i, t in rows]))) == components_by_hand(rows)


@pytest.mark.parametrize("name", ["op11_chosen_path", "op12_resampling", "op13_filter_audit"])
def test_same_rows_as_duckdb(spark, small_dir, name):
    assert differences(queries.queries()[name](spark, small_dir), connect(small_dir), queries.oracle_sql()[name]) == []


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_buckets_of_words():
    texts = [None, "", "AB-cd x" * 3, "é ÀB½", "y" * 500 + "-" + "Z" * 47, "\x00\x7f", "last1"]
    bucket, row = resample.word_buckets(*utf8(pa.array(texts, pa.string())), 1000)
    want = [(k, zlib.crc32(w.encode()) % 1000) for k, t in enumerate(texts) for w in re.findall(WORD, lower(t))]
    assert list(zip(row.tolist(), bucket.tolist(), strict=True)) == want


def drawn_by_hand(rows, target, percent, least):
    count = lambda texts: Counter(zlib.crc32(w.encode()) % 10000 for t in texts for w in re.findall(WORD, lower(t)))
    s, t = count(x for _, x in rows), count(target)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + 1e4) / ((s[b] + 1.0) * (sum(t.values()) + 1e4)))) for b in range(10000)]
    out = []
    for i, text in rows:
        words = re.findall(WORD, lower(text))
        weight = sum(gain[zlib.crc32(w.encode()) % 10000] for w in words)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = [x + (k + 1,) for k, x in enumerate(order[: percent * len(order) // 100])]
    return Counter(drawn) + (Counter(x + (None,) for x in out) - Counter(x[:4] + (None,) for x in drawn))


@pytest.mark.parametrize("few", [20_000, 3])
def test_resampling_of_odd_rows(spark, monkeypatch, few):
    monkeypatch.setattr(resample, "FEW", few)
    rows = [(i, t) for i, t, _ in ODD] + [(1000 + k, f"wort{k % 7} " * 30) for k in range(200)]
    target = ["wort3 wort3 wort4", None, "a b"]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(frame(spark, [(i, t, "en") for i, t in rows]), items, percent=35, least_words=2)
    assert Counter(tuple(r) for r in got.collect()) == drawn_by_hand(rows, target, 35, 2)
    assert resample.resample(frame(spark, []), items).count() == 0
    assert resample.resample(frame(spark, ODD), items.limit(0)).count() == len(ODD)
    with pytest.raises(TypeError):
        resample.resample(spark.createDataFrame([("a", "b")], "doc_id string, text string"), items)


def test_cutoff_of_repeated_keys(spark, monkeypatch):
    """A third of all keys are of one document; any place has its exact key, and ranks have no gap."""
    monkeypatch.setattr(resample, "FEW", 5)
    monkeypatch.setattr(resample, "RANGE", 50)
    rng = np.random.default_rng(3)
    keys = [(int(s), False, 7 if k % 3 == 0 else k, k) for k, s in enumerate(rng.integers(-9, 9, 600))] + [(2, True, None, 1000), (2, True, None, 1001)]
    table = spark.createDataFrame(keys, "score long, without boolean, id long, row long").repartition(7)
    order = sorted(keys, key=lambda k: (k[0], k[1], k[2] or 0, k[3]))
    for place in (1, 2, 300, 601, 602):
        assert resample.cutoff(table, place) == order[place - 1]
    assert resample.cutoff(table, 0) is None and resample.cutoff(table, 603) is None
    got = resample.ranked(table, ["score", "without", "id", "row"], 602).select("rank", "row").collect()
    assert sorted((r[0], r[1]) for r in got) == [(k + 1, x[3]) for k, x in enumerate(order)]


def test_galloping():
    rng = random.Random(4)
    for _ in range(400):
        lists = [sorted(rng.sample(range(60), rng.randrange(0, 40))) for _ in range(rng.randrange(0, 6))]
        assert filter_audit.union(lists) == sorted(set().union(*lists))
        a, b = (sorted(rng.sample(range(60), rng.randrange(0, 40))) for _ in "ab")
        assert filter_audit.difference(a, b) == sorted(set(a) - set(b))
        x, at = rng.randrange(-1, 62), rng.randrange(0, len(a) + 1)
        assert filter_audit.gallop(a, x, at) == next((k for k in range(at, len(a)) if a[k] >= x), len(a))


def audit_by_hand(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        mine = [x for x in labels if x[0] == i and i is not None]
        docs.append((part or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = Counter()
        for p in permutations("ABCDE"):
            for f in p:
                shapley[f] += sum(f in d[1] and not d[1] & set(p[: p.index(f)]) for d in own)
        for p in permutations("ABCDE"):
            for k, f in enumerate(p):
                removed = [d for d in own if f in d[1] and not d[1] & set(p[:k])]
                fails = sum(f in d[1] for d in own)
                out.append((part, "".join(p), k + 1, sum(not d[1] & set(p[: k + 1]) for d in own), len(removed), fails - len(removed), sum(d[1] == {f} for d in own), sum(d[2] for d in removed), sum(d[3] for d in removed), shapley[f]))
    return sorted(out)


def test_audit_of_odd_rows_in_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE", 7)
    rng = random.Random(9)
    texts = ["a b", "", "A#B", "some WORDS " * 60, "x y z " * 10, " ".join(f"v{k}" for k in range(150)), "HELLO there | " * 3]
    rows = [*ODD, *[(rng.choice((20, 21, 22, rng.randrange(1000))), rng.choice(texts), rng.choice(("en", "de", None))) for _ in range(90)]]
    labels = [(4, 1, 0), (4, 0, None), (20, 1, 1), (21, None, 1), (None, 1, 1), *[(k, k % 2, k % 3 == 0) for k in range(100, 700)]]
    labels = [(i, q, int(t) if t is not None else None) for i, q, t in labels]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(frame(spark, rows), table).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(tuple(r) for r in got.collect()) == audit_by_hand(rows, labels)
    assert filter_audit.audit_filters(frame(spark, []), table).count() == 0
    assert filter_audit.audit_filters(frame(spark, ODD), table.limit(0)).count() == 600 * 4


def test_sets_are_not_exchanged_for_each_join(spark):
    """Joins of pairs with the sets exchange the pairs only; before, each of them exchanged all sets twice."""
    join = chosen_path.Join(frame(spark, [(i, f"a b c d e f g h i j k l m n o p q r s t {i // 2}", "en") for i in range(40)]), "doc_id", "text", 85, 0.99999)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        join.run()
        names = [r["tableName"] for r in spark.sql("SHOW TABLES LIKE 'tables_*'").collect()]
        linked = join._similar(join.written(join.edges))
        plan = linked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and linked.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        join.folder.remove()
    assert names and not spark.sql("SHOW TABLES LIKE 'tables_*'").collect()


def test_entries_of_nodes_are_exchanged_once_a_level(spark, monkeypatch):
    """Before, they were made and exchanged once more for the small nodes and once for the large ones."""
    plans = []
    for name in ("written", "bucketed"):
        kept = getattr(chosen_path.Folder, name)
        monkeypatch.setattr(chosen_path.Folder, name, lambda self, df, *key, kept=kept: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(self, df, *key))
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    rows = [(i, f"a b c d e f g h i j k l m n o p q r s t {i // 2}", "en") for i in range(40)] + [(i, f"{i // 2} one two three four five six seven eight nine ten eleven twelve {i // 4 * 4}", "en") for i in range(40, 60)]
    join = chosen_path.Join(frame(spark, rows), "doc_id", "text", 85, 0.99999)
    join.hot = 1000
    try:
        join.run()
        assert sum(p.count("Generate explode(roots") for p in plans) == 2  # to be counted, and to be dealt
    finally:
        join.folder.remove()
