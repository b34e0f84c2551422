"""The publication API: lists and details in JSON as tables."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

LIST = "resultaten array<struct<document:struct<id:string,pid:string,titel:string,omschrijving:string,openbaarmakingsdatum:string,publisher:string,aanbieder:string,mutatiedatumtijd:string>,bestandsType:string>>"
_LABELS = "array<struct<label:string>>"
DETAIL = (
    "document struct<pid:string,weblocatie:string,omschrijvingen:array<string>,verantwoordelijke:struct<label:string>,titelcollectie:struct<officieleTitel:string>,"
    f"classificatiecollectie:struct<documentsoorten:{_LABELS},informatiecategorieen:{_LABELS}>>,"
    "documentrelaties array<struct<relation:string,role:string>>,"
    "versies array<struct<nummer:bigint,openbaarmakingsdatum:string,mutatiedatumtijd:string,bestanden:array<struct<id:string,bestandsnaam:string,`mime-type`:string,grootte:bigint,hash:string>>>>"
)


def _bare(ident: Column) -> Column:
    """An id without the suffix behind an underscore."""
    return F.get(F.split(ident, "_"), F.lit(0))


def entries(pages: DataFrame, column: str = "json") -> DataFrame:
    """A row for each result of the list pages that has a file."""
    rows = pages.select(F.explode(F.from_json(column, LIST)["resultaten"]).alias("r")).where("r.bestandsType IS NOT NULL")
    d = lambda name: F.coalesce(F.col(f"r.document.{name}"), F.lit("")).alias(name)
    return rows.select(_bare(F.col("r.document.id")).alias("id"), *[d(n) for n in ("titel", "omschrijving", "openbaarmakingsdatum", "mutatiedatumtijd", "publisher", "aanbieder")], F.col("r.bestandsType").alias("bestandsType"))


class ListSource(DataSource):
    """``spark.read.format("publication_list")``: the pages (day, page, json) of each day's list.

    Options: ``url`` with ``{day}`` and ``{page}`` (pages count from 0; saved pages are ``file://`` addresses), ``first`` and
    ``last`` day, ``allowed`` results of other days in a page (3). Each day is a partition and its pages are fetched in
    the task until ``of_day`` needs no more: an empty page, one with too much of other days, or none at the address. A
    page that is no JSON fails the task, for it may be fetched anew. With the option ``prune`` filters on ``day``
    decide which days are fetched; that needs the setting ``spark.sql.python.filterPushdown.enabled``. Without it they
    are applied to what was fetched.
    """

    @classmethod
    def name(cls) -> str:
        return "publication_list"

    def schema(self) -> str:
        return "day string, page int, json string"

    def reader(self, schema) -> DataSourceReader:
        return (_PrunedReader if self.options.get("prune", "false") == "true" else _ListReader)(dict(self.options))


class _Day(InputPartition):
    def __init__(self, day: str):
        self.day = day


#: What a filter on the day asks of one.
_ASKS = {
    EqualTo: lambda day, value: day == value,
    In: lambda day, value: day in value,
    GreaterThan: lambda day, value: day > value,
    GreaterThanOrEqual: lambda day, value: day >= value,
    LessThan: lambda day, value: day < value,
    LessThanOrEqual: lambda day, value: day <= value,
}


class _ListReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        first, last = date.fromisoformat(options["first"]), date.fromisoformat(options["last"])
        self.days = [(first + timedelta(days=k)).isoformat() for k in range((last - first).days + 1)]

    def partitions(self) -> list[InputPartition]:
        return [_Day(d) for d in self.days]

    def read(self, partition: _Day) -> Iterator[tuple]:
        page, other, results = 0, 0, [None]
        while results and other <= int(self.options.get("allowed", 3)):
            try:
                with urllib.request.urlopen(self.options["url"].format(day=partition.day, page=page), timeout=60) as answer:  # noqa: S310
                    text = answer.read().decode()
            except urllib.error.HTTPError as error:
                if error.code == 404:
                    return
                raise
            except urllib.error.URLError as error:
                if isinstance(error.reason, FileNotFoundError) or "No such file" in str(error.reason):
                    return
                raise
            results = json.loads(text).get("resultaten") or []
            other = sum((r.get("document") or {}).get("openbaarmakingsdatum") != partition.day for r in results)
            yield partition.day, page, text
            page += 1


class _PrunedReader(_ListReader):
    """Takes filters on the day; Spark refuses one that does while its setting is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _ASKS and f.attribute == ("day",):
                self.days = [d for d in self.days if _ASKS[type(f)](d, f.value)]
            else:
                yield f


def of_day(pages: DataFrame, column: str = "json", allowed: int = 3) -> DataFrame:
    """The results that a day's list is read for: (day, page, place, result struct ``r``).

    ``pages``: (day, page, json), the pages of each day's list in order. A page is read up to the place where
    more than ``allowed`` of its results are of other days, and no further page of that day is read; nor is any
    after an empty page.
    """
    rows = pages.select("day", "page", F.from_json(column, LIST)["resultaten"].alias("results"))
    other = lambda r: (~r["document"]["openbaarmakingsdatum"].eqNullSafe(F.col("day"))).cast("int")
    zero = F.struct(F.lit(0).alias("other"), F.lit(0).alias("read"))
    step = lambda s, r: F.struct((s["other"] + other(r)).alias("other"), (s["read"] + (s["other"] + other(r) <= allowed).cast("int")).alias("read"))
    rows = rows.withColumn("scan", F.aggregate(F.coalesce("results", F.array()), zero, step))
    ends = (F.col("scan.other") > allowed) | (F.coalesce(F.size("results"), F.lit(0)) <= 0)
    stops = rows.where(ends).groupBy("day").agg(F.min("page").alias("last"))
    rows = rows.join(F.broadcast(stops), "day", "left").where(F.col("last").isNull() | (F.col("page") <= F.col("last")))
    return rows.select("day", "page", F.posexplode(F.slice("results", F.lit(1), F.col("scan.read"))).alias("place", "r"))


def paged(rows: DataFrame, at: str, order: list[str], size: int, stretch: int = 60) -> DataFrame:
    """(day, page, resultaten): the lists of days, cut into pages of ``size`` that count from 0.

    ``rows``: (``at``, a time; ``days``, in whose lists the row stands; ``r``, the result), ordered by ``at`` and ``order``.
    Rows are numbered within stretches of so many seconds, and what lies before a stretch comes from one count for
    each, so no list meets in one task or row: a page is the largest group.
    """
    stretched = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / stretch).alias("__stretch")
    listed = rows.select(stretched, F.col(at).alias("__at"), *order, "r", F.explode(F.array_distinct("days")).alias("day"))
    listed = listed.withColumn("__n", F.row_number().over(Window.partitionBy("day", "__stretch").orderBy("__at", *order)))
    counts = listed.groupBy("day", "__stretch").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("day").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("day", "__stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__n") - 1
    placed = listed.join(offsets, ["day", "__stretch"]).select("day", F.floor(place / size).cast("int").alias("page"), F.struct(place.alias("place"), "r").alias("x"))
    pages = placed.groupBy("day", "page").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return pages.select("day", "page", F.transform("x", lambda x: x["r"]).alias("resultaten"))


def details(rows: DataFrame, id_col: str = "id", column: str = "json", parent_role: str = "hasPart") -> DataFrame:
    """A row for each detail document: first file of the first version, labels as JSON texts, the parent by its role."""
    p = rows.select(id_col, column, F.from_json(column, DETAIL).alias("d"))
    version = F.get(F.col("d.versies"), F.lit(0))
    file = F.get(version["bestanden"], F.lit(0))
    labels = lambda c: F.to_json(F.transform(F.coalesce(c, F.array().cast(_LABELS)), lambda x: x["label"]))
    parents = F.filter(F.col("d.documentrelaties"), lambda r: r["role"].endswith(parent_role))
    text = lambda c: F.coalesce(c, F.lit(""))
    return p.select(
        id_col, text(version["mutatiedatumtijd"]).alias("mutatiedatumtijd"), text(version["openbaarmakingsdatum"]).alias("openbaarmakingsdatum"),
        F.coalesce(version["nummer"], F.lit(0)).alias("versie"), text(file["bestandsnaam"]).alias("bestandsnaam"), text(file["id"]).alias("bestandsid"),
        text(file["mime-type"]).alias("contentType"), F.coalesce(file["grootte"], F.lit(0)).alias("grootte"), text(file["hash"]).alias("hash"),
        text(_bare(F.regexp_extract(F.get(parents, F.lit(0))["relation"], "([^/]*)$", 1))).alias("bronDocument"),
        text(F.col("d.document.titelcollectie.officieleTitel")).alias("titel"), text(F.col("d.document.verantwoordelijke.label")).alias("verantwoordelijke"),
        F.to_json(F.coalesce(F.col("d.document.omschrijvingen"), F.array().cast("array<string>"))).alias("omschrijvingen"),
        labels(F.col("d.document.classificatiecollectie.documentsoorten")).alias("documentsoorten"),
        labels(F.col("d.document.classificatiecollectie.informatiecategorieen")).alias("informatiecategorieen"),
        text(F.col("d.document.weblocatie")).alias("weblocatie"), F.col(column).alias("json"),
    )


def to_fetch(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Entries without details of their version."""
    return listed.join(known.select("id", "mutatiedatumtijd"), ["id", "mutatiedatumtijd"], "left_anti")
