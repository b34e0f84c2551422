"""Text, date and number columns of the record pages.

All are column expressions. Texts of the feed are never null where they are missing, they are ''; helpers
keep that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of days and months, by number.
WEEKDAYS = ("zondag", "maandag", "dinsdag", "woensdag", "donderdag", "vrijdag", "zaterdag")
MONTHS = ("januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december")
#: Characters and their entities.
ENTITIES = (("&", "&amp;"), ('"', "&quot;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;"))
#: Ministries and their abbreviations.
MINISTRIES = (
    ("Algemene Zaken", "AZ"), ("Defensie", "DEF"), ("Binnenlandse Zaken en Koninkrijksrelaties", "BZK"), ("Economische Zaken", "EZ"),
    ("Volksgezondheid, Welzijn en Sport", "VWS"), ("Sociale Zaken en Werkgelegenheid", "SZW"), ("Volkshuisvesting en Ruimtelijke Ordening", "VRO"),
    ("Klimaat en Groene Groei", "KGG"), ("Onderwijs, Cultuur en Wetenschap", "OCW"), ("Asiel en Migratie", "A&M"), ("Justitie en Veiligheid", "J&V"),
    ("Landbouw, Visserij, Voedselzekerheid en Natuur", "LVVN"), ("Infrastructuur en Waterstaat", "I&W"), ("Financiën", "FIN"),
    ("Buitenlandse Handel en Ontwikkelingshulp", "BHO"), ("Buitenlandse Zaken", "BZ"),
)
NARROW_SPACE, NARROW_DASH = " ", "‑"


def like_ci(c: Column, pattern: str) -> Column:
    """LIKE that takes a-z and A-Z as equal and all other letters as they are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(c, upper, lower).like(pattern.translate(str.maketrans(upper, lower)))


def text_or(c: Column, other: str = "") -> Column:
    return F.coalesce(c, F.lit(other))


def default_if_empty(c: Column, other: Column) -> Column:
    return F.when(text_or(c) == "", other).otherwise(c)


def leading_int(c: Column) -> Column:
    """The number a text begins with, 0 without one."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))


def leading_double(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def date10(c: Column) -> Column:
    """The date part of an ISO text."""
    return F.substring(c, 1, 10)


def date_minute(c: Column) -> Column:
    """``YYYY-MM-DD hh:mm`` of an ISO text; a fixed remark if it is too short."""
    return F.when(F.length(c) >= 16, F.concat(F.substring(c, 1, 10), F.lit(" "), F.substring(c, 12, 5))).otherwise(F.lit("Geen datum"))


def unbroken(c: Column) -> Column:
    """The same text with a space and dashes that don't break."""
    return F.translate(c, " -", NARROW_SPACE + NARROW_DASH)


def long_date(c: Column) -> Column:
    """A date in words, with weekday, the first letter upper case."""
    days, months = F.array(*[F.lit(d) for d in WEEKDAYS]), F.array(*[F.lit(m) for m in MONTHS])
    return F.concat_ws(" ", F.initcap(F.element_at(days, F.dayofweek(c))), F.dayofmonth(c).cast("string"), F.element_at(months, F.month(c)), F.year(c).cast("string"))


def local_epoch(c: Column, zone: str = "Europe/Amsterdam") -> Column:
    """Seconds since 1970 of a local wall-clock text; a zone suffix and fractions don't count. The session's zone must be UTC."""
    return F.unix_timestamp(F.to_utc_timestamp(F.try_to_timestamp(F.substring(F.replace(c, F.lit("T"), F.lit(" ")), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")), zone))


def utc_epoch(c: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(F.substring(F.replace(c, F.lit("T"), F.lit(" ")), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")))


def rss_epoch(c: Column) -> Column:
    """Seconds since 1970 of a date as in feeds (``Fri, 17 Jan 2025 06:07:07 GMT``), taken as UTC."""
    return F.unix_timestamp(F.try_to_timestamp(F.regexp_extract(c, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss")))


def rss_date(c: Column) -> Column:
    """A timestamp as in feeds."""
    return F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", " ")


def strip_styles(c: Column) -> Column:
    return F.regexp_replace(c, ' style="[^"]*"', "")


def html_escape(c: Column) -> Column:
    for plain, entity in ENTITIES:
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def _bytes(c: Column) -> Column:
    """The bytes of a text as pairs of lower-case hex digits."""
    code = F.lower(F.hex(F.encode(c, "UTF-8")))
    return F.regexp_extract_all(code, F.lit("(..)"), F.lit(1))


def _plain(kept: str) -> Column:
    """Map from hex pairs to the characters that stand for themselves."""
    chars = [chr(n) for n in range(33, 127) if chr(n).isalnum() or chr(n) in kept]
    return F.create_map(*[F.lit(x) for ch in chars for x in (f"{ord(ch):02x}", ch)])


def url_escape(c: Column) -> Column:
    """Percent-encoding with lower-case hex digits; letters, digits and ``-._~`` stay."""
    plain = _plain("-._~")
    return F.array_join(F.transform(_bytes(c), lambda b: F.coalesce(plain[b], F.concat(F.lit("%"), b))), "")


def file_name(c: Column) -> Column:
    """Every byte that is no ASCII letter or digit becomes a dash."""
    plain = _plain("")
    return F.array_join(F.transform(_bytes(c), lambda b: F.coalesce(plain[b], F.lit("-"))), "")


def quoted_printable(c: Column, width: int = 76) -> Column:
    """Quoted-printable text: ``=`` and bytes beyond printable ASCII as ``=XX``, CRLF line ends, soft breaks.

    A line has at most ``width`` characters, the ``=`` of a soft break included.
    """
    plain = F.create_map(*[F.lit(x) for n in range(32, 127) if n != 61 for x in (f"{n:02x}", chr(n))])
    signs = F.transform(_bytes(c), lambda b: F.when(b == "0a", F.lit("\n")).otherwise(F.coalesce(plain[b], F.concat(F.lit("="), F.upper(b)))))

    def step(state: Column, sign: Column) -> Column:
        size = F.length(sign)
        full = state["used"] + size > width - 1
        return (
            F.when(sign == "\n", F.struct(F.concat(state["out"], F.lit("\r\n")).alias("out"), F.lit(0).alias("used")))
            .when(full, F.struct(F.concat(state["out"], F.lit("=\r\n"), sign).alias("out"), size.alias("used")))
            .otherwise(F.struct(F.concat(state["out"], sign).alias("out"), (state["used"] + size).alias("used")))
        )

    return F.aggregate(signs, F.struct(F.lit("").alias("out"), F.lit(0).alias("used")), step, lambda s: s["out"])


def full_name(given: Column, infix: Column, surname: Column) -> Column:
    return F.concat_ws(" ", F.nullif(given, F.lit("")), F.nullif(infix, F.lit("")), F.nullif(surname, F.lit("")))


def short_id(c: Column, longest: int = 16, kept: int = 8) -> Column:
    """Long ids are cut for display."""
    return F.when(F.length(c) > longest, F.substring(c, 1, kept)).otherwise(c)


def comma_decimal(c: Column) -> Column:
    return F.replace(F.format_string("%.1f", c), F.lit("."), F.lit(","))


def latency_bucket(c: Column, buckets: int = 12) -> Column:
    """Upper bound of the power-of-two bucket a positive number falls into; the last takes the rest."""
    out = F.lit(1 << (buckets - 1))
    for k in reversed(range(buckets - 1)):
        out = F.when(c <= float(1 << k), F.lit(1 << k)).otherwise(out)
    return out


def content_kind(content: Column) -> Column:
    """Kind of a file by its first bytes."""
    head = F.lower(F.hex(F.substring(content, 1, 8)))
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.startswith("504b"), "zip")
        .when(head.startswith("3c3f786d6c") | head.startswith("efbbbf3c3f786d6c"[:16]), "xml")
        .when(head.startswith("d0cf11e0"), "ole")
        .when(head.startswith("7b5c72746631"), "rtf")
        .otherwise("")
    )


def ministry(addressee: Column) -> Column:
    """Ministry of an addressee's title: the prefix falls away, and the head of government stands for general affairs."""
    bare = F.regexp_replace(F.lower(F.trim(addressee)), r"^(viceminister-president, )?(minister|staatssecretaris) (van|voor) ", "")
    return F.when(F.lower(addressee).startswith("minister-president"), "algemene zaken").otherwise(bare)


def duration_seconds(begin: Column, end: Column) -> Column:
    """Seconds between two local wall-clock texts."""
    return utc_epoch(end) - utc_epoch(begin)


def max_or_null(a: Column, b: Column) -> Column:
    """The greater of two values, null if one is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def addressee(function: Column) -> Column:
    """The ministry that a member of government's function names; null for others."""
    bare = F.regexp_replace(function, "minister van |minister voor |staatssecretaris van ", "")
    name = F.when(bare == "minister-president", "Algemene Zaken").otherwise(bare)
    return F.when(function.contains("inister") | function.contains("taatssecretaris"), name)


def ministry_short(name: Column) -> Column:
    """A ministry's abbreviation; its name where there is none."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in MINISTRIES for x in pair])[name], name)


def odd_duration(seconds: Column, longest: int = 900) -> Column:
    """Whether a turn's length can't be right."""
    return (seconds < 0) | (seconds > longest)
