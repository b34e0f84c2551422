"""Personal data: known forms, and terms that reveal them.

Everything is a column expression or a DataFrame operation. Known forms (mail and network addresses, card
and telephone numbers) are the protected entities. A term reveals an entity as far as knowing the term
tells the entity: the information content of the entity less the pointwise mutual information of both is
what remains unknown, -log2 P(entity | term) bits. P is estimated from co-occurrence in the corpus, as the
share of the term's uses that stand within ``REACH`` characters of the entity in its line, and takes the
lower bound of its confidence interval, so that what was seen once or twice by chance doesn't count. A term
that leaves at most ``REMAINING`` bits is marked as a span of kind ``term`` wherever it stands. Different
stretches of text are the observations: copies of one text are one, and there are no more of them than uses. A use
counts once, for the nearest entity: words between two entities that are both in reach go half to either. Uses of
terms are counted over the words of all texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint
from tidemark.llm.spans import SPAN, bound, count_kind, in_blocks, listed, located, part, running

KINDS = ("email", "ip", "card", "phone", "term")
#: Written so that a match can only begin where the leftmost one does (at a run's start, or after a match), which keeps long runs linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP_VALID = rf"^{PART}\.{PART}\.{PART}\.{PART}$"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Texts without this hold none of them.
HINT = r"@|[0-9]"

#: Bits that a revealing term leaves unknown at most, and the width of the confidence interval in standard errors (80 %).
REMAINING, ERRORS = 1.0, 1.28
REACH = 80
TERM = r"[^\p{L}]+"
TERM_CHARS = 4
#: More revealing terms than this are joined to the texts' words instead of being put into the expression.
LITERAL_TERMS = 2000
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    digits = F.split(F.reverse(number), "")

    def step(total: Column, i: Column) -> Column:
        d = F.get(digits, i).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the known forms, by kind and then start."""

    def size(s: Column) -> Column:
        return F.length(_digits(s["match"]))

    cards = F.filter(located(text, CARD, 2), lambda s: F.when(size(s).between(13, 19), _luhn(_digits(s["match"]))).otherwise(F.lit(False)))
    phones = F.filter(located(text, PHONE, 3), lambda s: size(s).between(9, 15))
    return F.concat(located(text, EMAIL, 0), F.filter(located(text, IP, 1), lambda s: s["match"].rlike(IP_VALID)), cards, phones)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TERM), lambda w: F.length(w) >= TERM_CHARS)


def least_contexts() -> int:
    """Different stretches that a term needs with an entity before it can reveal it, however exclusive it is."""
    z2, p = ERRORS**2, 2.0**-REMAINING
    return math.ceil(p * z2 / (1 - p) - 1e-9)


def remaining_bits(seen: Column, others: Column) -> Column:
    """-log2 of the lower (Wilson) bound of a share: ``seen`` observations for it, ``others`` against it."""
    n, z2 = seen + others, ERRORS**2
    p = seen / n
    return -F.log2((p + z2 / 2 / n - ERRORS * F.sqrt(p * (1 - p) / n + z2 / 4 / n / n)) / (1 + z2 / n))


def revealing_terms(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n_term, n_with, stretches, bits) of the terms that reveal some entity; the one with fewest bits left counts."""
    lines = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike(HINT)).select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(HINT))

    def side(blocks: Column, start: Column, end: Column, shared: Column, first: bool) -> Column:
        """Words on one side of a match; of what lies between two matches within reach each gets its half, so a use counts once."""
        words = _words(part(blocks, F.least(start, end), end))
        half = F.ceil(F.size(words) / 2).cast("int")
        mine = F.slice(words, 1, half) if first else F.slice(words, half + 1, F.size(words))
        return F.when(shared, mine).otherwise(words)

    def places(blocks: Column, size: Column, spans: Column) -> Column:
        def place(s: Column, i: Column) -> Column:
            last, following = F.when(i > 0, F.get(spans, i - 1)["end"]), F.get(spans, i + 1)["start"]
            near = lambda gap: F.coalesce(gap < 2 * REACH, F.lit(False))
            near_last, near_next = near(s["start"] - last), near(following - s["end"])
            before = side(blocks, F.when(near_last, last).otherwise(F.greatest(s["start"] - REACH, F.lit(0))), s["start"], near_last, False)
            after = side(blocks, s["end"], F.when(near_next, F.greatest(following, s["end"])).otherwise(F.least(s["end"] + REACH, size)), near_next, True)
            stretch = F.concat_ws(" ", part(blocks, F.greatest(s["start"] - REACH, F.lit(0)), s["start"]), part(blocks, s["end"], F.least(s["end"] + REACH, size)))
            return F.struct(F.lower(s["match"]).alias("entity"), stretch.alias("around"), F.concat(before, after).alias("terms"))

        return F.transform(spans, place)

    found = bound(in_blocks(F.col("line")), lambda blocks: bound(F.length("line"), lambda size: bound(F.sort_array(base_spans(F.col("line"))), lambda spans: places(blocks, size, spans))))
    found = lines.select(F.explode(found).alias("p")).select("p.*")
    found = checkpoint(found.groupBy("entity", "around", "terms").agg(F.count(F.lit(1)).alias("times")))
    least = least_contexts()
    often = found.groupBy("entity").agg(F.count(F.lit(1)).alias("stretches")).where(F.col("stretches") >= least).select("entity")
    uses = found.join(often, "entity", "left_semi").select("entity", "times", F.explode("terms").alias("term"), "around")
    uses = uses.groupBy("entity", "term", "around").agg(F.sum("times").alias("times"))
    pairs = uses.groupBy("entity", "term").agg(F.sum("times").alias("n_with"), F.count(F.lit(1)).alias("stretches")).where(F.col("stretches") >= least)
    pairs = checkpoint(pairs)
    wanted = pairs.select("term").distinct()
    schema = "term string, n_term long, n_with long, stretches long, bits double"
    if pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    # Only words that can be terms are counted, where they are read if these are few; a frequent one is one row of each task.
    words = docs.select(F.explode(_words(F.col(text_col))).alias("term")).join(checkpoint(wanted), "term", "left_semi")
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    judged = pairs.join(counts, "term").withColumn("bits", remaining_bits(F.least("stretches", "n_term"), F.greatest(F.col("n_term") - F.col("n_with"), F.lit(0)))).where(F.col("bits") <= REMAINING)
    best = F.min_by(F.struct("n_term", "n_with", "stretches", "bits"), F.struct("bits", "entity")).alias("best")
    return judged.groupBy("term").agg(best).select("term", "best.*")


def with_spans(rows: DataFrame) -> DataFrame:
    """``rows`` (with columns id and text) with ``spans``: all spans, by kind and then start. Null texts have none.

    Other columns may have any name but ``terms``, ``spans`` and ``same_id``.
    """
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    terms = checkpoint(revealing_terms(rows).select("term"))
    few = [r["term"] for r in terms.limit(LITERAL_TERMS + 1).collect()]
    if not few:
        rows = rows.withColumn("terms", none)
    elif len(few) <= LITERAL_TERMS:
        rows = rows.withColumn("terms", F.array_intersect(_words(text), F.array(*[F.lit(t) for t in few])))
    else:
        held = rows.select(F.col("id").alias("same_id"), F.explode(F.array_distinct(_words(text))).alias("term")).join(terms, "term")
        held = held.groupBy("same_id").agg(F.collect_set("term").alias("terms"))
        rows = rows.join(held, F.col("id").eqNullSafe(F.col("same_id")), "left").drop("same_id").withColumn("terms", F.coalesce("terms", none))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    by_term = F.when(F.size("terms") > 0, located(text, pattern, 4)).otherwise(F.array().cast(SPAN))
    base = F.when(text.rlike(HINT), base_spans(text)).otherwise(F.array().cast(SPAN))
    return rows.withColumn("spans", F.concat(base, by_term) if few else base).drop("terms")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null text counts as empty and has no spans. Repeated rows give repeated results; other columns are
    not returned; an empty table gives an empty result.
    """
    found = with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < 4)
    return found.select(
        F.col("id").alias(id_col),
        *[count_kind(spans, k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])],
        F.sha2(listed(base, KINDS), 256).alias("base_sha256"),
        listed(spans, KINDS).alias("spans"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text generalised to labels such as ``[EMAIL]``.

    Spans that overlap get the label of the one that begins first. Null texts stay null and texts without
    spans stay as they are; ``n_chars``, if there, is set anew; all other columns are kept, whatever their
    names. Repeated rows give repeated results, an empty table an empty one.
    """
    found = with_spans(docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    labels = F.array(*[F.lit(x) for x in LABELS])

    def rewritten(blocks: Column, spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        done = F.concat(F.array(F.lit(0)), F.slice(reach, 1, F.size(spans) - 1))
        steps = F.filter(F.zip_with(spans, done, lambda s, d: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), d.alias("done"))), lambda x: x["start"] >= x["done"])
        kept = F.transform(steps, lambda x: F.concat(part(blocks, x["done"], x["start"]), F.element_at(labels, x["kind"] + 1)))
        return F.concat(F.array_join(kept, ""), part(blocks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length("text")))

    clean = bound(in_blocks(F.col("text")), lambda blocks: bound(F.sort_array("spans"), lambda spans: rewritten(blocks, spans)))
    out = found.select("row", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")).alias("text"))
    new = {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
