"""The change feed: pages of XML entries as a source, and entries as typed tables.

An entry names its entity by the child of its content, which holds scalar fields as elements and references
as elements with a ``ref`` attribute. Entities and fields may be added at any time, so entries are parsed into
maps first; a table is a choice of fields with types, and what is missing is ''.
"""

from __future__ import annotations

import re
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.functions.text import leading_double, leading_int

RAW = "category string, id string, skiptoken bigint, enclosure string, updated string, xml string"
PARSED = "entity string, id string, skiptoken bigint, updated string, bijgewerkt string, verwijderd boolean, content_type string, content_length string, fields map<string,string>, refs array<struct<name:string,ref:string>>"
#: References that are kept as edges, by entity.
LINKS = {
    "Activiteit": ("vervangenVanuit", "voortgezetVanuit"),
    "Document": ("activiteit", "zaak"),
    "Zaak": ("activiteit", "gerelateerdVanuit", "vervangenVanuit", "agendapunt"),
    "Toezegging": ("aanvullingOp", "herhalingVan", "wijzigingVan"),
}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(node: ET.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if _local(k).rpartition(":")[2] == name), "")


def read_page(text: bytes) -> tuple[list[tuple], str | None]:
    """Raw rows of a feed page, and the address of the next page. An entry without a token keeps the one before."""
    rows, token, following = [], 0, None
    root = ET.fromstring(text)
    for node in root:
        if _local(node.tag) == "link" and node.get("rel") == "next":
            following = node.get("href")
        if _local(node.tag) != "entry":
            continue
        enclosure = category = ident = updated = ""
        for child in node:
            name = _local(child.tag)
            if name == "title":
                ident = (child.text or "").strip()
            elif name == "updated":
                updated = (child.text or "").strip()
            elif name == "category":
                category = child.get("term", "").capitalize() if child.get("term", "").islower() else child.get("term", "")
            elif name == "link" and child.get("rel") == "enclosure":
                enclosure = child.get("href", "")
            elif name == "link" and child.get("rel") == "next":
                following = child.get("href", "")
                digits = following.rpartition("skiptoken=")[2].split("&")[0]
                token = int(digits) if digits.isdigit() else token
            elif name == "content" and len(child) and not category:
                category = _local(child[0].tag)
        rows.append((category, ident, token, enclosure, updated, ET.tostring(node, encoding="unicode")))
    return rows, following


def _fetch(address: str) -> bytes:
    with urllib.request.urlopen(address, timeout=60) as answer:  # noqa: S310
        return answer.read()


def _pages(address: str | None, most: int) -> Iterator[tuple]:
    seen = set()
    while address and address not in seen and len(seen) < most:
        seen.add(address)
        rows, address = read_page(_fetch(address))
        yield from rows


def _last_number(text: bytes) -> int | None:
    digits = re.findall(rb"\d+", text)
    return int(digits[-1]) if digits else None


class FeedSource(DataSource):
    """``spark.read.format("change_feed")`` or ``readStream``.

    Options: ``url`` with ``{category}`` and ``{token}`` (a page with what comes after the token), ``categories``
    (comma-separated), ``token`` to begin after (-1), ``pages`` for the most pages that a partition reads; ``end`` with
    ``{category}``, whose answer's last number is the newest token of a category, and ``step``, the tokens a partition has
    at most (100000). With ``end`` a category is read in ranges of tokens, each by a task of its own. A stream needs it:
    the driver asks for the newest tokens only, and no page passes through it.
    """

    @classmethod
    def name(cls) -> str:
        return "change_feed"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _FeedStream(self.options)


class _Range(InputPartition):
    """What a category has after the token ``low``, up to ``high`` if there is one."""

    def __init__(self, category: str, low: int, high: int | None = None):
        self.category, self.low, self.high = category, low, high


class _Feed:
    """What both readers share; it holds the options and nothing else, so it is sent to tasks."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def begin(self) -> dict:
        return {c.strip(): int(self.options.get("token", -1)) for c in self.options["categories"].split(",") if c.strip()}

    def end(self) -> dict:
        """The newest token of each category; one that has none stays where it begins."""
        out = {}
        for category, low in self.begin().items():
            newest = _last_number(_fetch(self.options["end"].format(category=category)))
            out[category] = low if newest is None else max(low, newest)
        return out

    def ranges(self, start: dict, end: dict) -> list[InputPartition]:
        step = int(self.options.get("step", 100_000))
        bounds = [(c, start.get(c, int(self.options.get("token", -1))), high) for c, high in end.items()]
        return [_Range(c, at, min(at + step, high)) for c, low, high in bounds for at in range(low, high, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        address = self.options["url"].format(category=partition.category, token=partition.low)
        for row in _pages(address, int(self.options.get("pages", 1_000_000))):
            if partition.high is not None and row[2] > partition.high:
                return
            if partition.high is None or row[2] > partition.low:
                yield row


class _FeedReader(_Feed, DataSourceReader):
    """A partition for each category, or for each range of its tokens if the end is known."""

    def partitions(self) -> list[InputPartition]:
        if "end" in self.options:
            return self.ranges(self.begin(), self.end())
        return [_Range(category, low) for category, low in self.begin().items()]


class _FeedStream(_Feed, DataSourceStreamReader):
    """Offsets hold the last token of each category, and a batch the ranges between two of them."""

    def __init__(self, options: dict):
        super().__init__(options)
        if "end" not in self.options:
            raise ValueError("a stream of the change feed needs the option 'end'")

    def initialOffset(self) -> dict:  # noqa: N802
        return self.begin()

    def latestOffset(self) -> dict:  # noqa: N802
        return self.end()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.ranges(start, end)


def parse_entries(raw: DataFrame) -> DataFrame:
    """Entries with their fields and references as maps; what is no XML is an entry of entity ``_corrupt`` with its text in the field ``xml``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    root = ET.fromstring(r.xml)
                except (ET.ParseError, TypeError):
                    rows.append(("_corrupt", r.id, r.skiptoken, r.updated, "", False, "", "", {"xml": r.xml or ""}, []))
                    continue
                content = next((c for c in root.iter() if _local(c.tag) == "content"), root)
                node = content[0] if content is not root and len(content) else root
                fields, refs = {}, []
                for child in node:
                    name, ref = _local(child.tag), _attribute(child, "ref")
                    if ref:
                        refs.append({"name": name, "ref": ref})
                    else:
                        fields[name] = "".join(child.itertext())
                rows.append((_local(node.tag)[:1].upper() + _local(node.tag)[1:], r.id or _attribute(node, "id"), r.skiptoken, r.updated, _attribute(node, "bijgewerkt"), _attribute(node, "verwijderd") == "true", _attribute(node, "contentType"), _attribute(node, "contentLength"), fields, refs))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("entity", "id", "skiptoken", "updated", "bijgewerkt", "verwijderd", "content_type", "content_length", "fields", "refs")])

    return raw.select("id", "skiptoken", "updated", "xml").mapInPandas(run, PARSED)


def entity_table(parsed: DataFrame, entity: str, columns: dict[str, str]) -> DataFrame:
    """A table of one entity: id, skiptoken, bijgewerkt, updated, verwijderd and ``columns`` (name -> string, bigint or double).

    A column ``xId`` that is no field is the reference ``x``. Missing values are '', numbers are what their text begins with.
    """
    rows = parsed.where(F.col("entity") == entity)
    out = []
    for name, kind in columns.items():
        value = F.coalesce(F.col("fields")[name], F.lit(""))
        if name.endswith("Id"):
            first = F.get(_refs(name[:-2]), F.lit(0))["ref"]
            value = F.coalesce(F.col("fields")[name], first, F.lit(""))
        out.append({"bigint": leading_int, "double": leading_double}.get(kind, lambda c: c)(value).alias(name))
    return rows.select("id", "skiptoken", "bijgewerkt", "updated", "verwijderd", *out)


def _refs(name: str):
    return F.filter("refs", lambda r: F.lower(r["name"]) == name.lower())


def edges(parsed: DataFrame) -> DataFrame:
    """(van, naar, category, linkSoort, skiptoken) of the references that are edges."""
    rows = parsed.select("entity", "id", "skiptoken", F.explode("refs").alias("r"))
    wanted = F.lit(False)
    for entity, names in LINKS.items():
        wanted |= (F.col("entity") == entity) & F.col("r.name").isin(*names)
    return rows.where(wanted).select(F.col("id").alias("van"), F.col("r.ref").alias("naar"), F.col("entity").alias("category"), F.concat(F.upper(F.substring("r.name", 1, 1)), F.expr("substring(r.name, 2)")).alias("linkSoort"), "skiptoken")


XML = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def _typed(raw: DataFrame, entity: str, fields: list[str], refs: list[str]) -> DataFrame:
    """The entries of one entity by ``from_xml``: the entry's columns and its entity as the struct ``e``."""
    node = entity[:1].lower() + entity[1:]
    names = ["_id", "_bijgewerkt", "_verwijderd", *dict.fromkeys(fields)]
    inner = ", ".join([*(f"`{n}`: string" for n in names), *(f"`{n}`: array<struct<_ref: string>>" for n in dict.fromkeys(refs))])
    schema = f"content struct<`{node}`: struct<{inner}>>, _corrupt_record string"
    parsed = raw.select("id", "skiptoken", "updated", F.from_xml("xml", F.lit(schema), XML)["content"][node].alias("e")).where("e IS NOT NULL")
    return parsed.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), "e._id", F.lit("")))


def typed_table(raw: DataFrame, entity: str, columns: dict[str, str]) -> DataFrame:
    """``entity_table`` from raw entries, parsed in the JVM by the entity's own schema; only the fields asked for are kept.

    The entity's element has its name with a small first letter, and fields hold text only. Entries of other entities
    give no row, nor does what is no XML: ``bad_entries`` has that. Nulls and empty texts are bad entries.
    """
    refs = [n[:-2] for n in columns if n.endswith("Id")]
    rows = _typed(raw, entity, list(columns), refs)
    out = []
    for name, kind in columns.items():
        value = F.col("e")[name]
        if name.endswith("Id"):
            value = F.coalesce(value, F.get(F.col("e")[name[:-2]], F.lit(0))["_ref"])
        value = F.coalesce(value, F.lit(""))
        out.append({"bigint": leading_int, "double": leading_double}.get(kind, lambda c: c)(value).alias(name))
    return rows.select("id", "skiptoken", F.coalesce("e._bijgewerkt", F.lit("")).alias("bijgewerkt"), "updated", F.coalesce(F.col("e._verwijderd") == "true", F.lit(False)).alias("verwijderd"), *out)


def typed_edges(raw: DataFrame) -> DataFrame:
    """``edges`` from raw entries, parsed in the JVM."""
    parts = []
    for entity, names in LINKS.items():
        tagged = lambda name: F.transform(F.coalesce(F.col("e")[name], F.array()), lambda r: F.struct(r["_ref"].alias("ref"), F.lit(name[:1].upper() + name[1:]).alias("kind")))
        each = F.explode(F.concat(*[tagged(n) for n in names]))
        rows = _typed(raw, entity, [], list(names)).select("id", "skiptoken", each.alias("r")).where("r.ref <> ''")
        parts.append(rows.select(F.col("id").alias("van"), F.col("r.ref").alias("naar"), F.lit(entity).alias("category"), F.col("r.kind").alias("linkSoort"), "skiptoken"))
    return reduce(DataFrame.unionByName, parts)


def is_xml(c: Column) -> Column:
    """Whether a text is one well-formed XML document; false for null and what is empty."""
    return F.coalesce(F.from_xml(c, F.lit("_none string, _corrupt_record string"), XML)["_corrupt_record"].isNull() & (F.trim(c) != ""), F.lit(False))


def bad_entries(raw: DataFrame) -> DataFrame:
    """(id, skiptoken, xml) of the entries that are no XML."""
    return raw.where(~is_xml(F.col("xml"))).select("id", "skiptoken", "xml")


def field_use(parsed: DataFrame) -> DataFrame:
    """(entity, field, filled, entries, percent): which fields each entity has, and how often they hold something."""
    total = parsed.groupBy("entity").agg(F.count(F.lit(1)).alias("entries"))
    each = parsed.select("entity", F.explode("fields").alias("field", "value")).groupBy("entity", "field").agg(F.count_if(F.trim("value") != "").alias("filled"))
    return each.join(total, "entity").withColumn("percent", F.round(F.lit(100.0) * F.col("filled") / F.col("entries"), 2))
