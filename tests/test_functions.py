"""Scalar functions on literal vectors."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (X.html_escape, "bert & ernie", "bert &amp; ernie"),
        (X.html_escape, "<a href='x'>\"", "&lt;a href=&apos;x&apos;&gt;&quot;"),
        (X.url_escape, "salt & pepper", "salt%20%26%20pepper"),
        (X.url_escape, "kaasbroodje", "kaasbroodje"),
        (X.url_escape, "é~-._", "%c3%a9~-._"),
        (X.strip_tags, "<html><body>Hallo allemaal!</body></html>", "  Hallo allemaal!  "),
        (X.strip_styles, '<p style="color:red">x</p>', "<p>x</p>"),
        (X.rss_epoch, "Fri, 17 Jan 2025 06:07:07 GMT", 1737094027),
        (X.local_epoch, "2024-07-01T12:00:00.123", 1719828000),
        (X.local_epoch, "2024-01-01T12:00:00", 1704106800),
        (X.utc_epoch, "2024-01-01T12:00:00Z", 1704110400),
        (X.leading_int, " 12abc", 12),
        (X.leading_int, "x", 0),
        (X.leading_double, "12.5 euro", 12.5),
        (X.file_name, "aé b", "a---b"),
        (X.date_minute, "2024-01-02T03:04:05", "2024-01-02 03:04"),
        (X.date_minute, "2024", "Geen datum"),
        (X.ministry, "minister van Financiën", "financiën"),
        (X.ministry, "minister-president", "algemene zaken"),
        (X.short_id, "12345678901234567", "12345678"),
        (X.short_id, "1234", "1234"),
        (X.quoted_printable, "plain", "plain"),
        (X.quoted_printable, "a=b", "a=3Db"),
        (X.quoted_printable, "ö", "=C3=B6"),
        (X.quoted_printable, "a\nb", "a\r\nb"),
        (X.quoted_printable, "x" * 80, "x" * 75 + "=\r\n" + "x" * 5),
    ],
)
def test_text(spark, function, given, wanted):
    assert value(spark, function(F.lit(given))) == wanted


def test_like_is_blind_to_ascii_case_only(spark):
    assert value(spark, X.like_ci(F.lit("ABCé"), "abc_")) is True
    assert value(spark, X.like_ci(F.lit("É"), "é")) is False


def test_dates_in_words(spark):
    assert value(spark, X.long_date(F.lit("2024-03-05").cast("date"))) == "Dinsdag 5 maart 2024"


def test_names_skip_empty_parts(spark):
    assert value(spark, X.full_name(F.lit("Jan"), F.lit(""), F.lit("Berg"))) == "Jan Berg"


@pytest.mark.parametrize(("number", "bucket"), [(0.5, 1), (1.0, 1), (1.5, 2), (1024.0, 1024), (5000.0, 2048)])
def test_latency_bucket(spark, number, bucket):
    assert value(spark, X.latency_bucket(F.lit(number))) == bucket


@pytest.mark.parametrize(("head", "kind"), [(b"%PDF-1.4", "pdf"), (b"PK\x03\x04", "zip"), (b"<?xml version", "xml"), (b"\xef\xbb\xbf<?xml ve", "xml"), (b"\xd0\xcf\x11\xe0", "ole"), (b"{\\rtf1", "rtf"), (b"hello", "")])
def test_content_kind(spark, head, kind):
    frame = spark.createDataFrame([(head,)], "content binary")
    assert frame.select(X.content_kind(F.col("content")).alias("x")).first()["x"] == kind
