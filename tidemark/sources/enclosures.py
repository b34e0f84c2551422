"""Stored files: kinds, text, audits, and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import content_kind, duration_seconds, strip_tags
from tidemark.sources.feed import XML, is_xml


def files(spark: SparkSession, path: str, overlay: str | None = None) -> DataFrame:
    """(id, content, length) of all files below ``path``, the name without folders being the id; a file of the overlay
    takes the place of one with the same id."""

    def read(p: str) -> DataFrame:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p)
        return rows.select(F.regexp_extract("path", "([^/]+)$", 1).alias("id"), "content", "length")

    base = read(path)
    if overlay is None:
        return base
    better = read(overlay).select("id", F.col("content").alias("c2"), F.col("length").alias("l2"))
    return base.join(better, "id", "full").select("id", F.coalesce("c2", "content").alias("content"), F.coalesce("l2", "length").alias("length"))


def stored_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the files below a folder, without reading them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.regexp_extract("path", "([^/]+)$", 1).alias("id"))


def audit(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """``wanted`` with ``outcome`` by size and SHA-1: missing, wrongsize, wronghash or ok. ``wanted``: (id, size, hash); a null hash is not compared.

    Sizes and digests are taken where the files are read, so no content is exchanged for the join.
    """
    measured = stored.where("content IS NOT NULL").select("id", F.length("content").alias("__size"), F.sha1("content").alias("__sha1"))
    rows = wanted.join(measured, "id", "left")
    outcome = F.when(F.col("__size").isNull(), "missing").when(F.col("__size") != F.col("size"), "wrongsize").when(F.col("__sha1") != F.lower("hash"), "wronghash").otherwise("ok")
    return rows.select(*wanted.columns, outcome.alias("outcome"))


def texts(stored: DataFrame) -> DataFrame:
    """(id, kind, text): XML and HTML without styles and tags, plain text as it is, nothing for formats that need a converter."""
    kind = content_kind(F.col("content"))
    text = F.decode("content", "UTF-8")
    plain = F.trim(F.regexp_replace(strip_tags(F.regexp_replace(text, r"(?s)<style.*?</style>", " ")), r"\s+", " "))
    return stored.select("id", kind.alias("kind"), F.when(kind == "xml", plain).when(kind == "", F.when(text.contains("<html"), plain).otherwise(text)).otherwise("").alias("text"))


def count_elements(docs: DataFrame, xml_col: str, name: str = "vraag") -> DataFrame:
    """``docs`` with the number of elements of a name as ``aantal``."""
    return docs.withColumn("aantal", F.size(F.xpath(xml_col, F.lit(f"//{name}"))))


TURN = "spreker struct<_objectid: string, voornaam: string, achternaam: string, fractie: string>, markeertijdbegin string, markeertijdeind string, isvoorzitter string, _corrupt_record string"
KINDS = ("woordvoerder", "interrumpant")


def turns(transcripts: DataFrame) -> DataFrame:
    """A row for each turn of the transcripts (meeting, xml): who spoke, from when to when, and what; all in the JVM.

    An interruption within a speech is a turn too, and its words are not the speaker's. A transcript that is no XML has
    no turns: ``bad_transcripts`` has it.
    """
    plain = transcripts.where(is_xml(F.col("xml"))).select("meeting", F.regexp_replace("xml", r"(</?)[\w.-]+:", "$1").alias("xml"))
    parts = lambda kind: F.regexp_extract_all("xml", F.lit(rf"(?s)<{kind}(?:\s[^>]*[^/>])?>.*?</{kind}\s*>"), F.lit(0))
    tagged = lambda kind: F.transform(parts(kind), lambda part: F.struct(F.lit(kind).alias("kind"), part.alias("part")))
    rows = plain.select("meeting", F.explode(F.concat(*[tagged(kind) for kind in KINDS])).alias("t")).select("meeting", "t.kind", "t.part")
    rows = rows.withColumn("s", F.from_xml("part", F.lit(TURN), XML))
    of = lambda name: F.trim(F.coalesce(F.col(f"s.{name}"), F.lit("")))
    who = {"speaker": "spreker._objectid", "given": "spreker.voornaam", "surname": "spreker.achternaam", "party": "spreker.fractie", "begin": "markeertijdbegin", "end": "markeertijdeind"}
    said = F.trim(F.regexp_replace(F.xpath_string("part", F.lit("/*/tekst")), r"(?U)\s+", " "))
    return rows.select("meeting", "kind", *[of(c).alias(n) for n, c in who.items()], (of("isvoorzitter") == "true").alias("chair"), said.alias("text"))


def bad_transcripts(transcripts: DataFrame) -> DataFrame:
    """(meeting, length) of the transcripts that are no XML; the length of null is 0."""
    return transcripts.where(~is_xml(F.col("xml"))).select("meeting", F.coalesce(F.length("xml"), F.lit(0)).alias("length"))


def speaking_time(spoken: DataFrame) -> DataFrame:
    """Seconds of each speaker in each meeting by role; the chair's role goes before the others."""
    seconds = F.coalesce(duration_seconds(F.col("begin"), F.col("end")), F.lit(0))
    role = F.when(F.col("chair"), "chair").otherwise(F.col("kind"))
    names = {"speaker_seconds": "woordvoerder", "interrupter_seconds": "interrumpant", "chair_seconds": "chair"}
    return spoken.withColumns({"seconds": seconds, "role": role}).groupBy("meeting", "speaker").agg(
        F.sum("seconds").alias("seconds"), *[F.coalesce(F.sum(F.when(F.col("role") == r, F.col("seconds"))), F.lit(0)).alias(n) for n, r in names.items()]
    )
