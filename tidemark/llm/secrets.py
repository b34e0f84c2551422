"""Secret scan: known forms, and strings of high entropy.

Everything is a column expression. Known forms are found by pattern. Candidates for the entropy test are
runs of at least ``WINDOW`` characters of letters, digits and ``+/_=-``. A window slides over a candidate
and carries the counts of its characters: the one that leaves and the one that enters change two counts,
the sum of c*log2(c) over all counts (from which the Shannon entropy follows), and the numbers of characters
outside each class. What counts as high depends on the class of the window's characters, so a key that is
joined to a label or path is judged by itself. A high window holds letters and digits. A span runs from the
first to the last high window of a candidate. Spans on the allow list are left alone: words and numbers
joined by separators (slugs, paths, dates), UUIDs, digests that say so, placeholders.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import bound, count_kind, listed, located, running

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
#: Classes of characters, and the entropy (bits a character) that is high for a window within one; the first that holds counts.
CLASSES = ((string.hexdigits, 3.0), (string.digits + string.ascii_lowercase + "_=-", 3.7), (string.digits + string.ascii_uppercase + "_=-", 3.7))
MIXED = 3.9
#: Places of the characters in the counts, by code from '+' to 'z'.
BASE, CODES = ord("+"), ord("z") - ord("+") + 1
#: A part without a letter beside a digit consists of words and numbers with separators.
JOINED = r"[A-Za-z][0-9]|[0-9][A-Za-z]"
#: Candidates that are no secret as a whole.
KNOWN = (r"^([A-Za-z]++[-_=/])?[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"(?i)^(sha-?(1|224|256|384|512)|md5)[-_=]")
#: Signs of a placeholder, in spans up to so many characters; in a longer one they stand by chance.
PLACEHOLDER, PLACEHOLDER_CHARS = r"(?i)example|placeholder|changeme|your[-_]|xxxx|0123456789|abcdefghijkl", 64


def _outside(chars: str) -> Column:
    return F.array(*[F.lit(int(chr(BASE + k) not in chars)) for k in range(CODES)])


def hot_part(candidate: Column) -> Column:
    """(first, last) of the windows of ``candidate`` with high entropy, as offsets into it (end exclusive); (-1, -1) without any."""
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    flags = [_outside(chars) for chars, _ in CLASSES] + [_outside(string.ascii_letters), _outside(string.digits)]
    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.ascii(c) - BASE)
    pairs = bound(codes, lambda c: F.transform(c, lambda x, i: F.struct(i.alias("i"), x.alias("enters"), F.when(i >= WINDOW, F.get(c, i - WINDOW)).otherwise(-1).alias("leaves"))))

    def step(state: Column, p: Column) -> Column:
        counts, enters, leaves = state["counts"], p["enters"], p["leaves"]
        less, more = F.get(counts, leaves), F.get(counts, enters) - F.when(enters == leaves, 1).otherwise(0)
        gone = F.when(leaves >= 0, F.get(terms, less - 1) - F.get(terms, less)).otherwise(0.0)
        total = state["total"] + gone + F.get(terms, more + 1) - F.get(terms, more)
        now = F.when(enters == leaves, counts).otherwise(F.transform(counts, lambda n, k: F.when(k == enters, n + 1).when(k == leaves, n - 1).otherwise(n)))
        outside = [state[f"out{k}"] + F.get(f, enters) - F.when(leaves >= 0, F.get(f, leaves)).otherwise(0) for k, f in enumerate(flags)]
        limit = F.lit(MIXED)
        for (_, bits), out in reversed(list(zip(CLASSES, outside, strict=False))):
            limit = F.when(out == 0, F.lit(bits)).otherwise(limit)
        both = (outside[-2] < WINDOW) & (outside[-1] < WINDOW)
        high = (p["i"] >= WINDOW - 1) & both & (F.lit(math.log2(WINDOW)) - total / WINDOW >= limit - 1e-9)
        return F.struct(
            now.alias("counts"),
            total.alias("total"),
            *[out.alias(f"out{k}") for k, out in enumerate(outside)],
            F.when(high & (state["first"] < 0), p["i"] - WINDOW + 1).otherwise(state["first"]).alias("first"),
            F.when(high, p["i"] + 1).otherwise(state["last"]).alias("last"),
        )

    zero = F.struct(
        F.array(*[F.lit(0)] * CODES).alias("counts"), F.lit(0.0).alias("total"), *[F.lit(0).alias(f"out{k}") for k in range(len(flags))], F.lit(-1).alias("first"), F.lit(-1).alias("last")
    )
    return F.aggregate(pairs, zero, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def entropy_spans(text: Column) -> Column:
    """Spans of high entropy that are not on the allow list."""

    def doubtful(s: Column) -> Column:
        test = s["match"].rlike(JOINED)
        for pattern in KNOWN:
            test &= ~s["match"].rlike(pattern)
        return test

    def suspect(s: Column) -> Column:
        return s["match"].rlike(JOINED) & ((F.length(s["match"]) > PLACEHOLDER_CHARS) | ~s["match"].rlike(PLACEHOLDER))

    hot = F.transform(F.filter(located(text, CANDIDATE, 3), doubtful), lambda s: F.struct(s.alias("s"), hot_part(s["match"]).alias("hot")))
    cut = F.transform(
        F.filter(hot, lambda x: x["hot"]["first"] >= 0),
        lambda x: F.struct(
            (x["s"]["start"] + x["hot"]["first"]).alias("start"),
            F.lit(3).alias("kind"),
            (x["s"]["start"] + x["hot"]["last"]).alias("end"),
            F.substring(x["s"]["match"], x["hot"]["first"] + 1, x["hot"]["last"] - x["hot"]["first"]).alias("match"),
        ),
    )
    return F.filter(cut, suspect)


def _uncovered(spans: Column) -> Column:
    """Sorted spans without those of kind 3 that lie within one of another kind."""
    reach = running(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
    both = F.zip_with(spans, reach, lambda s, r: F.struct(s.alias("s"), r.alias("reach")))
    return F.transform(F.filter(both, lambda x: (x["s"]["kind"] < 3) | (x["reach"] < x["s"]["end"])), lambda x: x["s"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text counts as empty and has no spans. Each row stands alone, so repeated rows give repeated
    results; other columns are not read; an empty table gives an empty result. Texts may be of any length
    and hold any number of matches and candidates.
    """
    found = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    text = F.col("__text")
    assign = F.filter(located(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= 12)
    base = F.concat(assign, located(text, ACCESS, 1), located(text, HEX, 2))
    found = found.select(id_col, F.sort_array(F.concat(base, entropy_spans(text))).alias("__all"))
    found = found.select(id_col, F.filter("__all", lambda s: s["kind"] < 3).alias("__base"), bound(F.col("__all"), _uncovered).alias("__all"))
    base = F.col("__base")
    return found.select(
        id_col,
        *[count_kind(base, k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])],
        F.sha2(listed(base, KINDS), 256).alias("base_sha256"),
        listed(F.col("__all"), KINDS).alias("spans"),
    )
