"""The text operators against brute force, and on odd tables."""

import hashlib
import math
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, components, decontaminate, fingerprints, language, language_model, ngram_join, pii, quality, secrets, sharding

SCHEMA = "doc_id long, text string, lang string, score double, spans string, size long, component_id long, shard int, block int, id long, __text string"
PIECES, TOKENIZER = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def frame(spark, texts, parts=3):
    rows = [(i, t, "en" if (i or 0) % 2 else "de", 0.5, "x", 1, 2, 3, 4, 5, "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def sample(spark, small_dir, n=200):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(n).collect()]


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a b"), (4, "a b"), (5, "A  b"), (6, "x" * 30_000), (7, "word " * 4_000), (None, "an orphan without an id, but with some text"), (8, "é🎉 token = abcdefghijklmnop1 a.b@c.de"),
    (9, "die straße " * 50), (9, "same id, other text"), (-5, "negative id"),
]
RUNS = {
    "quality": lambda d, labels: quality.classify_quality(d, labels),
    "sharding": lambda d, _: sharding.assign_shards(d, 8),
    "fingerprints": lambda d, _: fingerprints.fingerprint_documents(d),
    "secrets": lambda d, _: secrets.find_secrets(d),
    "join": lambda d, _: ngram_join.near_duplicates(d),
    "model": lambda d, _: language_model.score_texts(d),
    "language": lambda d, _: language.identify_languages(d, PIECES),
    "bpe": lambda d, _: bpe.encode(d, TOKENIZER),
    "pii": lambda d, _: pii.find_pii(d),
    "sanitise": lambda d, _: pii.sanitise(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_give_one_row_each(spark, name):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, 1, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = RUNS[name](docs, labels).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in ODD)


def test_numerals_and_symbols_are_no_letters(spark):
    rows = [chr(n) * 3 for n in range(0x20, 0x3000, 7) if unicodedata.category(chr(n))[0] in "MNPSZ"] + ["½ ²", "Ⅷ", "①", "12"]
    docs = frame(spark, [(k, t) for k, t in enumerate(rows)] + [(10_000 + k, "the cat sat" if k % 2 else "die katze sitzt") for k in range(20)])
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify_languages(docs, PIECES).collect()}
    assert {got[k] for k in range(len(rows))} == {"und"} and got[10_000] != "und"


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables_give_empty_results(spark, name):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert RUNS[name](frame(spark, ODD).where("false"), labels).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


# sharding


def jump_by_hand(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_move_only_into_the_new_one(spark, small_dir):
    texts = sample(spark, small_dir)
    out = sharding.assign_shards(frame(spark, texts + [texts[0]] * 500), 8).collect()
    by_id = dict(texts)
    for r in out:
        assert r["shard"] == jump_by_hand(r["doc_id"], 8) and r["grown_shard"] in (r["shard"], 8)
        assert r["size"] == len(by_id[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(by_id[r["doc_id"]].encode())
    for s in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_a_row_that_repeats_gets_gapless_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 7)
    out = sharding.assign_shards(frame(spark, [(1, "a")] * 100 + [(2, "b")] * 15), 1).collect()
    assert sorted(r["slot"] for r in out) == list(range(115)) and {r["shard"] for r in out} == {0}


def test_large_ids_keep_their_order(spark):
    texts = [(2**60 + k, f"text {k}.") for k in range(50)] + [(None, "none")]
    out = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(frame(spark, texts), blocks=5).collect()}
    by_id = dict(texts)
    for k in range(1, 50):
        mine, following = by_id[2**60 + k], by_id[2**60 + k - 1]
        assert out[2**60 + k]["edited_sha256"] == hashlib.sha256((mine[: len(mine) - len(mine) // 2] + following[: len(mine) // 2]).encode()).hexdigest()


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = frame(spark, [(i, str(i)) for i in range(100)])
    sharding.write_shards(docs, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and all(r["shard"] == jump_by_hand(r["doc_id"], 5) for r in back.collect())


# fingerprints


def test_peeling_finds_the_difference_and_grows_if_stuck():
    rng = np.random.default_rng(1)
    key = rng.integers(1, 2**63, 4000, dtype=np.uint64)
    for common, a, b in ((0, 0, 0), (100, 3, 2), (50, 60, 0), (1000, 900, 1100), (0, 1, 0)):
        x, y = key[: common + a], np.append(key[:common], key[-b:] if b else key[:0])
        ((only_x, only_y),) = fingerprints.differences([x], [y])
        assert set(only_x.tolist()) == set(x.tolist()) - set(y.tolist()) and set(only_y.tolist()) == set(y.tolist()) - set(x.tolist())


def test_fingerprints_by_hand(spark, small_dir):
    texts = sample(spark, small_dir, 60)
    out = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(frame(spark, texts), blocks=7).collect()}
    order = sorted(texts, reverse=True)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        a, b, c = (Counter(fingerprints.keys(x).tolist()) for x in (t, changed, following))
        like = lambda x, y: sum((x & y).values()) / (sum((x | y).values()) or 1)
        assert out[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and out[i]["n_chars"] == len(t)
        assert out[i]["near_edited"] == pytest.approx(like(a, b)) and out[i]["near_next"] == pytest.approx(like(a, c))


def test_equal_texts_have_equal_fingerprints(spark):
    out = fingerprints.fingerprint_documents(frame(spark, [(1, "a. b\nc"), (2, "a. b\nc"), (3, "d")])).collect()
    by = {r["doc_id"]: r for r in out}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] != by[3]["fingerprint"] and by[2]["near_next"] == 1.0


# secrets and personal data

FRAGMENTS = [
    "token", "=", "secret: ", "'", '"', "AKIA", "ABCDEFGH12345678", "abcdef0123456789", "24be64439e3e49cf", "@", "a.b", "mail.com", "x@y.z", "1.2.3.4", "999.1.1.1", ".5", "+1 (487) 555-7209",
    "4736962573099581", "4532 0151 1283 0366", "4485-2757-4230-8327 ", "-", " ", "\n", "é", "🎉", "password", "api_key", "0" * 20, "+49", "(030)", "12345", "user%", "PassWD : Abc123456789",
]


def strings():
    rng = np.random.default_rng(5)
    return [(k, "".join(rng.choice(FRAGMENTS, rng.integers(0, 14)))) for k in range(400)] + [(1000, None), (1001, "1" * 3000), (1002, "x@" * 300), (1003, "AKIA" * 500)]


def secret_spans(t):
    key = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16])


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def private_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_secrets_of_known_forms(spark):
    out = {r["doc_id"]: r for r in secrets.find_secrets(frame(spark, strings())).collect()}
    for i, t in strings():
        want = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in secret_spans(t or ""))
        assert out[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [s for s in out[i]["spans"].split(",") if s and not s.startswith("entropy")] == [s for s in want.split(",") if s]
        assert [out[i]["n_assign"], out[i]["n_access"], out[i]["n_hex"]] == [sum(k == j for _, k, _ in secret_spans(t or "")) for j in range(3)]


def hot_windows(s):
    def high(w):
        limit = next((b for chars, b in secrets.CLASSES if set(w) <= set(chars)), secrets.MIXED)
        return re.search("[0-9]", w) and re.search("[A-Za-z]", w) and -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values()) >= limit - 1e-9

    hot = [k for k in range(len(s) - 19) if high(s[k : k + 20])]
    return (hot[0], hot[-1] + 20) if hot else (-1, -1)


def test_entropy_by_hand(spark):
    rng = np.random.default_rng(2)
    strings = ["aZ3kLm9QpX7rTv2WnB8y", "a1" * 20, "deadbeef" * 4, "Qw7" + "a" * 30 + "aZ3kLm9QpX7rTv2WnB8yU5", "Key_" + "0123456789ABCDEF" * 2, "Key_8F3A0C7D19E5B2648D0FA37C5E91B264"]
    for letters in ("abcdefgh0123456789XYZ", "0123456789ABCDEF_", "abcdefghijklmnopqrstuvwxyz0123456789=", "AB+/19_-="):
        strings += ["".join(rng.choice(list(letters), 60)) for _ in range(12)]
    got = [tuple(r["h"]) for r in spark.createDataFrame([(s,) for s in strings], "s string").coalesce(1).select(secrets.hot_part(F.col("s")).alias("h")).collect()]
    assert got == [hot_windows(s) for s in strings]
    assert got[4][0] >= 0 and got[5] != (-1, -1)  # a key joined to a label is judged by its own class


@pytest.mark.parametrize("name", ["secrets", "pii"])
def test_very_long_texts_in_seconds(spark, name):
    rng = np.random.default_rng(8)
    run = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), 300_000))
    texts = [(1, run), (2, "ab-12-" * 200_000), (3, "a.b@c.de 10.1.2.3, token=abcdefghijkl0 " * 30_000), (4, "0123456789abcdef " * 50_000), (5, "1" * 300_000), (6, "a1-" * 100_000), (7, "+1(" * 100_000)]
    began = time.time()
    out = {r["doc_id"]: r["spans"].split(",") for r in RUNS[name](frame(spark, texts, 7), None).collect()}
    assert time.time() - began < 120
    if name == "secrets":
        assert [s for s in out[1] if s.startswith("entropy")] == [f"entropy:{hot_windows(run)[0]}:{hot_windows(run)[1]}"] and out[2] == [""]
        assert len(out[3]) == 30_000 and len(out[4]) == 50_000 and out[3][-1] == f"assign:{len(texts[2][1]) - 20}:{len(texts[2][1]) - 1}"
    else:
        assert [s.split(":")[0] for s in out[3]][:60_000] == ["email"] * 30_000 + ["ip"] * 30_000 and out[3][0] == "email:0:8"
        clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, [*texts[:2], (3, "a.b@c.de 10.1.2.3, é x\n" * 30_000)], 3)).collect()}
        assert clean[3] == "[EMAIL] [IP], é x\n" * 30_000 and clean[2] == texts[1][1]


@pytest.mark.parametrize(("text", "found"), [
    ("key aZ3kLm9QpX7rTv2WnB8y end", True), ("see /path/to/some-file-name-2024/part-12", False), ("id 123e4567-e89b-12d3-a456-426614174000", False),
    ("sha256-aZ3kLm9QpX7rTv2WnB8yaZ3k", False), ("EXAMPLEaZ3kLm9QpX7rTv2WnB8y", False), ("internationalizationinternationalization", False),
])
def test_entropy_and_the_allow_list(spark, text, found):
    assert ("entropy" in secrets.find_secrets(frame(spark, [(1, text)])).first()["spans"]) is found


def test_personal_data_of_known_forms(spark):
    out = {r["doc_id"]: r for r in pii.find_pii(frame(spark, strings())).collect()}
    for i, t in strings():
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in private_spans(t or ""))
        assert out[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_revealing_terms_are_found_and_common_ones_are_not(spark):
    texts = [(k, f"the bird zephyrine {'abcdefg'[k % 7]} wrote to zoe@mail.com on day {k}") for k in range(8)] + [(100 + k, f"the bird wrote letter {k} to nobody") for k in range(400)]
    texts += [(900 + k, "the parrot quetzalino wrote to ann@mail.com") for k in range(50)]  # copies are one context
    docs = frame(spark, texts)
    terms = {r["term"] for r in pii.revealing_terms(docs).collect()}
    assert "zephyrine" in terms and not {"bird", "wrote", "quetzalino"} & terms
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[3] == "the bird [TERM] d wrote to [EMAIL] on day 3" and clean[101] == "the bird wrote letter 1 to nobody"


def test_term_statistics_by_hand(spark):
    rng = np.random.default_rng(11)
    names, addresses = [f"name{'abcdefghij'[k]}" for k in range(10)], [f"u{k}@mail.com" for k in range(4)]
    texts = [(k, f"{rng.choice(names)} and {rng.choice(names)} told {rng.choice(addresses)} of {rng.choice(names)}" + (f" far {'away ' * 40} {rng.choice(names)}" if k % 3 == 0 else "")) for k in range(60)]
    texts += [(100 + k, texts[0][1]) for k in range(5)] + [(200, "solo wrote rare@mail.com"), (201, "duo wrote twin@mail.com now"), (202, "duo wrote twin@mail.com then")]
    words_of = lambda t: [w for w in re.split(r"[^a-z]+", t.lower()) if len(w) >= 4]
    uses, stretches, all_ = Counter(), {}, Counter(w for _, t in texts for w in words_of(t))
    for _, t in texts:
        matches = list(re.finditer(r"[a-z0-9]+@mail\.com", t))
        for w in re.finditer(r"[a-z]{4,}", t.lower()):  # each place of a word has one owner at most
            if any(m.start() < w.end() and w.start() < m.end() for m in matches):
                continue
            last = max((m for m in matches if m.end() <= w.start()), key=lambda m: m.end(), default=None)
            following = min((m for m in matches if m.start() >= w.end()), key=lambda m: m.start(), default=None)
            owner = None
            if last and following and following.start() - last.end() < 160:
                between = [x.start() for x in re.finditer(r"[a-z]{4,}", t[last.end() : following.start()].lower())]
                owner = last if between.index(w.start() - last.end()) < math.ceil(len(between) / 2) else following
            elif last and w.end() <= last.end() + 80:
                owner = last
            elif following and w.start() >= following.start() - 80:
                owner = following
            if owner:
                around = t[max(0, owner.start() - 80) : owner.start()] + " " + t[owner.end() : owner.end() + 80]
                uses[owner[0], w[0]] += 1
                stretches.setdefault((owner[0], w[0]), set()).add(around)
    want = {}
    for (e, w), seen in stretches.items():
        k, others = min(len(seen), all_[w]), max(all_[w] - uses[e, w], 0)
        n, z2 = k + others, 1.28**2
        p = k / n
        bits = -math.log2((p + z2 / 2 / n - 1.28 * math.sqrt(p * (1 - p) / n + z2 / 4 / n / n)) / (1 + z2 / n))
        if bits <= 1 and bits < want.get(w, 9):
            want[w] = bits
    got = {r["term"]: r["bits"] for r in pii.revealing_terms(frame(spark, texts)).collect()}
    assert got == pytest.approx(want) and pii.least_contexts() == 2 and not {"solo", "told"} & set(got)


def test_a_use_between_two_addresses_counts_once(spark):
    texts = [(k, "alpha a@b.co zebra a@b.co beta") for k in (1, 2)] + [(k, "zebra") for k in (3, 4)]
    assert pii.revealing_terms(frame(spark, texts)).count() == 0
    assert [r["spans"] for r in pii.find_pii(frame(spark, texts)).orderBy("doc_id").collect()][2:] == ["", ""]


def test_many_revealing_terms_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(pii, "LITERAL_TERMS", 0)
    test_revealing_terms_are_found_and_common_ones_are_not(spark)


# near duplicates


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    lists = {}
    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in lists.get(g, ()))
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for g in sets[i]:
            lists.setdefault(g, []).append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def made_texts():
    rng = np.random.default_rng(1)
    vocab = [f"w{k}" for k in range(3000)]
    doc = lambda n: [str(w) for w in rng.choice(vocab, n)]
    shared, base, head, out = doc(50), doc(120), doc(9), []
    for _ in range(80):
        d = list(base)
        for _ in range(rng.integers(0, 6)):
            d[rng.integers(len(d))] = str(rng.choice(vocab))
        out.append(d)
    out += [shared + doc(rng.integers(0, 20)) for _ in range(60)] + [doc(rng.integers(0, 300)) + shared + doc(rng.integers(0, 300)) for _ in range(30)] + [head + doc(rng.integers(0, 4)) for _ in range(80)]
    for _ in range(40):
        d = doc(rng.integers(1, 200))
        out.append(d)
        for _ in range(rng.integers(0, 4)):
            e = list(d)
            for _ in range(rng.integers(0, 8)):
                e[rng.integers(len(e))] = str(rng.choice(vocab))
            out.append(e)
    texts = [" ".join(d) for d in out] + ["", "  ", "a b", "A  b", "a", "a"] + [" ".join(base)] * 40
    order = rng.permutation(len(texts))
    return [(int(k), texts[j]) for k, j in enumerate(order)]


@pytest.mark.parametrize(("short", "extra"), [(1, 2), (4, 0), (32, 2), (32, 5)])
def test_components_by_brute_force(spark, monkeypatch, short, extra):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "EXTRA", extra)
    monkeypatch.setattr(ngram_join, "PART", 8)
    texts = made_texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_components_of_the_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()} == brute_components(texts)


def test_one_document_of_each_group_stays(spark):
    texts = made_texts()
    want = {i for i, (_, c) in brute_components(texts).items() if i == c}
    kept = ngram_join.one_of_each(frame(spark, texts + [(None, "no id")]))
    assert {r["doc_id"] for r in kept.collect()} == want | {None} and kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_the_heap_merge_counts_occurrences():
    rng = np.random.default_rng(9)
    for _ in range(300):
        lists = [sorted(set(rng.integers(0, 40, rng.integers(0, 25)).tolist())) for _ in range(rng.integers(0, 9))]
        for least in (1, 2, 3, 5):
            count = Counter(x for one in lists for x in one)
            assert ngram_join.occurrences(lists, least) == sorted((x, n) for x, n in count.items() if n >= least)


def test_one_row_stays_of_repeated_rows(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    texts = [(1, a)] * 5 + [(2, a), (3, b), (3, b), (4, a + " x"), (5, "lone words"), (5, "other text"), (6, None), (6, None), (7, ""), (None, a), (None, a)] + [(3, a)]
    kept = Counter((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(frame(spark, texts)).collect())
    assert kept == {(1, a): 1, (3, b): 1, (5, "lone words"): 1, (5, "other text"): 1, (6, None): 2, (7, ""): 1, (None, a): 2}


def test_a_shingle_that_all_share(spark):
    texts = [(k, f"a b c d e {k} " + " ".join(f"w{k}x{j}" for j in range(k % 3))) for k in range(20_000)]
    out = ngram_join.near_duplicates(frame(spark, texts, 8))
    assert out.where("component_id <> doc_id").count() == 0 and out.count() == 20_000


@pytest.mark.parametrize("small", [20_000, 3])
def test_connected_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    rng = np.random.default_rng(3)
    edges = [(k, k + 1) for k in range(100)] + [(1000, 1000 + k) for k in range(1, 60)] + [tuple(map(int, rng.integers(2000, 2200, 2))) for _ in range(100)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        assert got[node] == min(seen)
    assert set(got) == set(near)


# contained items


def test_containment_by_brute_force(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    sets = {r["item_id"]: shingles(r["text"]) for r in items.collect()}
    want = {}
    for r in docs.select("doc_id", "text").collect():
        own = shingles(r["text"])
        for i, s in sets.items():
            if len(own & s) >= 0.75 * len(s):
                want[r["doc_id"], i] = len(own & s)
    out = decontaminate.contained_items(docs, items)
    assert {(r["doc_id"], r["item_id"]): r["shared"] for r in out.collect()} == want
    left = decontaminate.without_items(docs, items)
    assert left.count() == docs.count() - len({d for d, _ in want}) and left.columns == docs.columns


def test_scattered_and_short_items_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 4)
    rng = np.random.default_rng(4)
    doc = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    items = [doc(n) for n in (3, 7, 15, 20, 40, 57, 57)]
    texts = [doc(5000) + item + doc(9000) for item in items] + [doc(3000) + items[5][:30] + doc(3000) + items[5][27:] + doc(10), doc(5000), items[0], []]
    docs = frame(spark, [(k, " ".join(t)) for k, t in enumerate(texts)] + [(77, None)])
    held = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(50, None), (51, "")], "item_id long, text string")
    want = {(k, i) for k, t in enumerate(texts) for i, item in enumerate(items) if len(shingles(" ".join(t)) & shingles(" ".join(item))) >= 0.75 * len(shingles(" ".join(item)))}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs, held).collect()} == want
    assert decontaminate.contained_items(docs, held.limit(0)).count() == 0 and decontaminate.without_items(docs, held.limit(0)).count() == docs.count()


def test_long_items_leave_short_ones_alone(spark):
    rng = np.random.default_rng(14)
    doc = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    items = [doc(n) for n in (20, 100, 2_000, 8_000, 20_000)]
    texts = [doc(n) + item + doc(300) for item in items for n in (0, 17, 4_000)] + [doc(40_000), items[4][:15_200], items[4][:14_000]]
    block = decontaminate.Items(list(range(5)), [" ".join(t) for t in items], 0.75)
    assert max(len(g.seeds) for g in block.groups) <= 50 and len(block.groups) == 5
    want = {(k, i) for k, t in enumerate(texts) for i, item in enumerate(items) if len(shingles(" ".join(t)) & shingles(" ".join(item))) >= 0.75 * len(shingles(" ".join(item)))}
    held = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(0, " ".join(items[0]))] * 3, "item_id long, text string")
    out = decontaminate.contained_items(frame(spark, [(k, " ".join(t)) for k, t in enumerate(texts)]), held).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == want and (16, 4) in want and Counter(r["item_id"] for r in out)[0] == 4 * 3


# language model


def test_base_scores_and_counts_by_hand(spark, small_dir):
    texts = sample(spark, small_dir) + [(5001, None), (5002, ""), (5003, " one")]
    out = {r["doc_id"]: r for r in language_model.score_texts(frame(spark, texts)).collect()}
    tokens = {i: [*words(t), None] for i, t in texts}
    count = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(count[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), abs=1e-6)
    held = [r for r in out.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_follow_from_counts_and_weights(spark, small_dir, monkeypatch):
    monkeypatch.setattr(language_model, "learn_weights", lambda cells, uniform: np.tile([0.5, 0.3, 0.2], (64, 1)))
    texts = sample(spark, small_dir, 60)
    out = {r["doc_id"]: r["score"] for r in language_model.score_texts(frame(spark, texts)).collect()}
    tokens = {i: [*words(t), None] for i, t in texts}
    one, two = Counter(), Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(t)
            two.update(zip(["<", *t[:-1]], t, strict=True))
    n, v = sum(one.values()), len(one)
    one["<"] = one[None]
    for i, t in tokens.items():
        p = [0.5 * (two[a, b] / one[a] if one[a] else 0) + 0.3 * one[b] / n + 0.2 / (v + 1) for a, b in zip(["<", *t[:-1]], t, strict=True)]
        assert out[i] == pytest.approx(sum(map(math.log10, p)), abs=1e-6)


# languages


def test_forward_sums_all_segmentations():
    vocab = language.pieces(PIECES)
    rng = np.random.default_rng(0)
    p = rng.random((vocab.unknown + 1, 2))
    for word in ("the", "zeit", "日本"):
        text = language.MARK + word

        def total(k, lang, text=text):
            if k == len(text):
                return 1.0
            found = [(j, i) for j in range(k + 1, len(text) + 1) if (i := names.get(text[k:j])) is not None]
            if not any(j == k + 1 for j, _ in found):
                found.append((k + 1, vocab.unknown))
            return sum(p[i, lang] * total(j, lang) for j, i in found)

        names = {x: i for i, x in enumerate(vocab.names)}
        alpha, _ = language.forward(vocab, [word], p)
        assert alpha[0, len(text)] == pytest.approx([total(0, 0), total(0, 1)])


def test_expected_uses_by_all_segmentations():
    vocab = language.pieces(PIECES)
    names = {x: i for i, x in enumerate(vocab.names)}
    rng = np.random.default_rng(3)
    p = rng.random((vocab.unknown + 1, 1))
    words_, times = ["the", "zeit", "日本", "a", "there"], np.array([3.0, 1.0, 2.0, 5.0, 1.0])

    def segmentations(text, k):
        if k == len(text):
            yield []
        found = [(j, names[text[k:j]]) for j in range(k + 1, len(text) + 1) if text[k:j] in names]
        if k < len(text) and not any(j == k + 1 for j, _ in found):
            found.append((k + 1, vocab.unknown))
        for j, i in found:
            for rest in segmentations(text, j):
                yield [i, *rest]

    want = np.zeros(vocab.unknown + 1)
    for word, n in zip(words_, times, strict=True):
        ways = [(x, math.prod(p[i, 0] for i in x)) for x in segmentations(language.MARK + word, 0)]
        total = sum(weight for _, weight in ways)
        for x, weight in ways:
            for i in x:
                want[i] += n * weight / total
    assert np.allclose(language.expected(vocab, words_, times, p), want)


def test_held_out_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language.identify_languages(docs, PIECES).join(docs, "doc_id").where("held_out").collect()
    assert len(out) > 100 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)
    und = language.identify_languages(docs.select("doc_id", "lang", F.lit("12 %").alias("text")).limit(5).unionByName(docs.select("doc_id", "lang", "text")), PIECES)
    assert und.where("lang_pred = 'und' AND score = 0").count() == 5


# quality


def statistics_by_hand(t):
    words_, chars, lines = [w for w in re.split(r"[ \t\n\x0B\f\r]+", t) if w], len(t), t.split("\n")
    letters = [unicodedata.category(c) for c in t]
    share = lambda n: n / (chars + 1)
    return {
        "log_chars": math.log1p(chars), "word_chars": chars / (len(words_) + 1), "distinct_words": len(set(words_)) / (len(words_) + 1), "upper": share(letters.count("Lu")),
        "digit": share(sum(c in "0123456789" for c in t)), "symbol": share(sum(k[0] not in "LN" and c not in " \t\n\x0B\f\r.," for c, k in zip(t, letters, strict=True))),
        "mark": share(t.count("!") + t.count("?")), "bar": share(t.count("|")), "lines": len(lines) / (len(words_) + 1), "distinct_lines": len(set(lines)) / len(lines),
        "line_chars": math.log1p(chars / len(lines)), "short_words": sum(len(w) <= 3 for w in words_) / (len(words_) + 1),
        "sentence_words": len(words_) / (sum(c in ".!?" for c in t) + 1), "commonest": max(Counter(words_).values(), default=0) / (len(words_) + 1),
    }


def test_statistics_by_hand(spark, small_dir):
    texts = sample(spark, small_dir, 80) + [(9001, ""), (9002, None), (9003, "a a b\n\na | É ½! 12?"), (9004, "Zwei  zwei\tdrei.\n" * 50), (9005, "\n\n")]
    out = quality.with_statistics(frame(spark, texts)).collect()
    by_id = dict(texts)
    for r in out:
        want = statistics_by_hand(by_id[r["doc_id"]] or "")
        assert {k: r[f"__{k}"] for k in quality.STATISTICS} == pytest.approx(want)


def test_held_out_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in out)


def test_compiled_rules_score_as_the_arrays_do(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    names = [f"__{k}" for k in quality.STATISTICS]
    data = quality.with_statistics(docs).withColumn("s", model.score()).select(*names, "s").toPandas()
    x = data[names].to_numpy(float)
    total = model.bias + quality._holds(x, [path for _, path in model.rules]) @ np.array([w for w, _ in model.rules])
    assert 0 < len(model.rules) <= 150 and np.allclose(data["s"], 1 / (1 + np.exp(-total)))


# tokens


def test_tokens_are_the_librarys(spark, small_dir):
    texts = [t for _, t in sample(spark, small_dir)]
    texts += ["", " ", " don't WE'LL İstanbul ΑΣ Σ ς ǅ é <|endoftext|>x<|startoftext|> \x1c\x85 ​ 123 １２ ½ ..!!'s'star " + "ab" * 500, "日本語 🎉🎉 \u0000 à́", "́x \x1d y"]
    lib = Tokenizer.from_file(TOKENIZER)
    out = {r["doc_id"]: r for r in bpe.encode(frame(spark, list(enumerate(texts))), TOKENIZER, ids=True).collect()}
    codec = bpe.codec(TOKENIZER)
    for k, t in enumerate(texts):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert out[k]["ids"] == ids and out[k]["n_tokens"] == len(ids)
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert codec.decode(ids) == decoded and out[k]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_the_automaton_accepts_what_merging_gives():
    rng = np.random.default_rng(6)
    for _ in range(60):
        vocab, merges = {"a": 0, "b": 1, "c": 2, "a</w>": 3, "b</w>": 4, "c</w>": 5}, []
        for _ in range(12):
            u, v = rng.choice([t for t in vocab if not t.endswith("</w>")]), rng.choice(list(vocab))
            if u + v not in vocab:
                vocab[str(u + v)] = len(vocab)
                merges.append((str(u), str(v)))
        machine = bpe.Automaton(vocab, merges)
        for _ in range(40):
            word = "".join(rng.choice(list("abc"), rng.integers(1, 9)))
            parts = [*word[:-1], word[-1] + "</w>"]
            rank = {m: k for k, m in enumerate(merges)}
            while pairs := [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]:
                _, k = min(pairs)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert [machine.label[t] for t in machine.encode(word)] == parts


def test_tokens_do_not_depend_on_the_encoders_memory(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    want = sorted(map(tuple, bpe.encode(docs, path).collect()))
    assert sorted(map(tuple, bpe.encode(docs, path, remember=7, most=500).collect())) == want and len(want) >= 200
