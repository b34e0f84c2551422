"""Feeds of documents for readers, and the texts that tell what a hit is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import rss_date, text_or

ITEM = ("title", "description", "link", "guid", "pubdate")


def items(rows: DataFrame, feed: Column, at: Column) -> DataFrame:
    """(feed, at, title, description, link, guid, pubdate): an item for each row of (nummer, onderwerp, titel, naam, bijgewerkt).

    ``naam`` is the lead committee, empty where there is none; ``at`` is what a feed is ordered by, newest first.
    Equal items of a feed are one.
    """
    number, subject = F.col("nummer").cast("string"), text_or(F.col("onderwerp"))
    told = F.concat(text_or(F.col("naam")), F.lit(" | "), text_or(F.col("titel")), F.lit(" "), subject)
    link = F.concat(F.lit("document.html?nummer="), number)
    return rows.select(
        feed.alias("feed"), at.alias("at"), subject.alias("title"), told.alias("description"), link.alias("link"),
        F.concat(F.lit("record_"), number).alias("guid"), rss_date(F.col("bijgewerkt")).alias("pubdate"),
    ).distinct()


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _element(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), _escaped(text_or(c)), F.lit(f"</{name}>"))


def channels(feed_items: DataFrame, feeds: DataFrame, site: str, now: Column) -> DataFrame:
    """(feed, items, xml): one RSS document for each of ``feeds`` (feed, title, about), items newest first, then by guid.

    The date of the channel is that of its first item; a feed without items tells ``now``. The items are put together
    as texts before they are gathered, so a group holds what its reader will get and no more; feeds are bounded by
    the days that their items are taken from.
    """
    item = F.concat(F.lit("<item>"), *[_element(c if c != "pubdate" else "pubDate", F.col(c)) for c in ITEM], F.lit("</item>"))
    # Sorted upwards by what grows with age: the negated second, then the guid.
    each = F.struct((-F.unix_micros(F.col("at").cast("timestamp"))).alias("age"), "guid", item.alias("item"), "pubdate")
    gathered = feed_items.groupBy("feed").agg(F.array_sort(F.collect_list(each)).alias("all"))
    rows = feeds.join(gathered, "feed", "left")
    first = F.get("all", F.lit(0))["pubdate"]
    dated = F.when(first.isNotNull(), _element("lastBuildDate", first)).otherwise(_element("pubDate", rss_date(now)))
    head = F.concat(_element("title", F.col("title")), _element("description", F.col("about")), _element("link", F.lit(site)))
    body = F.coalesce(F.array_join(F.transform("all", lambda x: x["item"]), ""), F.lit(""))
    xml = F.concat(F.lit('<?xml version="1.0" encoding="utf-8" standalone="yes"?><rss version="2.0"><channel>'), dated, head, body, F.lit("</channel></rss>"))
    return rows.select("feed", F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("items"), xml.alias("xml"))


def _activity() -> Column:
    when = F.col("datum")
    shown = F.when(F.length(when) > 10, F.overlay(when, F.lit(" "), 11)).otherwise(when)
    dated = F.when(text_or(when) == "", " (nog geen datum)").otherwise(F.concat(F.lit(" ("), shown, F.lit(")")))
    return F.concat(F.coalesce(F.concat("soort", F.lit(" "), "onderwerp"), F.lit("")), dated)


def _gift() -> Column:
    names = [text_or(F.col(c)) for c in ("roepnaam", "tussenvoegsel", "achternaam")]
    return F.concat(F.lit("Geschenk aan "), F.concat_ws(" ", *names), F.lit(": "), text_or(F.col("omschrijving")))


def _commitment() -> Column:
    return F.concat(F.lit("Toezegging van "), text_or(F.col("naam")), F.lit(" ("), text_or(F.col("ministerie")), F.lit("): "), text_or(F.col("tekst")))


#: What a hit of each category is called, from a table of that category.
DESCRIBED = {
    "Document": lambda: text_or(F.col("onderwerp")),
    "Verslag": lambda: text_or(F.col("titel")),
    "OODocument": lambda: text_or(F.col("titel")),
    "Activiteit": _activity,
    "PersoonGeschenk": _gift,
    "Toezegging": _commitment,
}


def described(hits: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``hits`` (category, nummer, ...) with ``description`` from the table of their category, by one join for all.

    A table has ``nummer`` and the columns that its category tells of; of rows with the same number the least text counts.
    A hit that its table does not hold is described by an empty text, one of a category without a table by null.
    """
    unknown = set(tables) - set(DESCRIBED)
    if unknown:
        raise ValueError(f"No descriptions for {sorted(unknown)}")
    told = [t.select(F.lit(name).alias("category"), F.col("nummer"), DESCRIBED[name]().alias("description")) for name, t in tables.items()]
    each = reduce(DataFrame.unionByName, told).groupBy("category", "nummer").agg(F.min("description").alias("description"))
    rows = hits.join(each, ["category", "nummer"], "left")
    known = F.col("category").isin(list(tables))
    return rows.select(*hits.columns, F.when(known, F.coalesce("description", F.lit(""))).alias("description"))
