"""Matching of speakers' names with persons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_names(speakers: DataFrame, people: DataFrame) -> DataFrame:
    """``speakers`` (with given, surname) with ``person`` of ``people`` (person, given, infix, surname), or null.

    The surname is tried whole first; then, step by step, one word more of its end is taken as the infix
    ("Berg van den" is "van den" "Berg"). The first attempt that matches anybody counts, if it matches
    exactly one. All attempts are candidates of one join.
    """
    words = F.split("surname", " ")
    attempts = F.transform(
        F.sequence(F.lit(0), F.size(words) - 1),
        lambda k: F.struct(
            k.alias("step"),
            F.array_join(F.slice(words, F.lit(1), F.size(words) - k), " ").alias("try_surname"),
            F.array_join(F.when(k > 0, F.slice(words, F.size(words) - k + 1, k)).otherwise(F.array().cast("array<string>")), " ").alias("try_infix"),
        ),
    )
    tried = speakers.select(*speakers.columns, F.explode(attempts).alias("a")).select(*speakers.columns, "a.*")
    who = people.select("person", F.lower("given").alias("pg"), F.lower("infix").alias("pi"), F.lower("surname").alias("ps"))
    hits = tried.join(who, (F.lower("given") == F.col("pg")) & (F.lower("try_surname") == F.col("ps")) & (F.lower("try_infix") == F.col("pi")))
    per = hits.groupBy(*speakers.columns, "step").agg(F.count(F.lit(1)).alias("n"), F.min("person").alias("person"))
    best = per.groupBy(*speakers.columns).agg(F.min(F.struct("step", "n", "person")).alias("m"))
    found = best.select(*speakers.columns, F.when(F.col("m.n") == 1, F.col("m.person")).alias("person"))
    return speakers.join(found, speakers.columns, "left")
