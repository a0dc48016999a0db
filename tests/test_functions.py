"""Boundaries of scalar expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from compatlake.functions import fields, scores, snippets
from compatlake.sources.listing import snapshot_date

NOW = dt.datetime(2026, 1, 1)
MS = dt.timedelta(milliseconds=1)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "age, recency, freshness",
    [
        (-dt.timedelta(days=3), 1.0, "fresh"),
        (dt.timedelta(0), 1.0, "fresh"),
        (dt.timedelta(days=30), 1.0, "fresh"),
        (dt.timedelta(days=30) + MS, 0.95, "fresh"),
        (dt.timedelta(days=90) - MS, 0.85, "fresh"),
        (dt.timedelta(days=90), 0.85, "recent"),
        (dt.timedelta(days=90) + MS, 0.75, "recent"),
        (dt.timedelta(days=365) - MS, 0.4, "recent"),
        (dt.timedelta(days=365), 0.24, "stale"),
        (dt.timedelta(days=730) - MS, 0.12, "stale"),
        (dt.timedelta(days=730), 0.05, "historical"),
        (None, 0.0, "fresh"),
    ],
)
def test_age_boundaries(spark, age, recency, freshness):
    ts = F.lit(None if age is None else NOW - age).cast("timestamp")
    row = spark.range(1).select(
        scores.recency(ts, F.lit(NOW)).alias("r"), scores.freshness(ts, F.lit(NOW)).alias("f")
    ).first()
    assert (row["r"], row["f"]) == (recency, freshness)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1710000000", "2024-03-09 16:00:00"),
        (" 1710000000.5 ", "2024-03-09 16:00:00"),
        ("1710000000000", "2024-03-09 16:00:00"),
        ("2024-03-09T16:00:00.250Z", "2024-03-09 16:00:00"),
        ("2024-03-09T16:00:00Z", "2024-03-09 16:00:00"),
        ("2024-03-09T16:00:00+02:00", "2024-03-09 14:00:00"),
        ("2024-03-09T16:00:00", "2024-03-09 16:00:00"),
        ("2024-03-09 16:00:00", "2024-03-09 16:00:00"),
        ("2024-03-09", "2024-03-09 00:00:00"),
        ("0", None),
        ("-5", None),
        ("", None),
        ("nope", None),
        ("2024-02-30", None),
        ("12:00:00", None),
    ],
)
def test_report_time(spark, text, expected):
    parsed = F.date_format(fields.report_time_text(F.trim(F.lit(text))), "yyyy-MM-dd HH:mm:ss")
    assert one(spark, parsed) == expected


@pytest.mark.parametrize(
    "name, expected",
    [
        ("reports_jun1_2026.tar.gz", dt.date(2026, 6, 1)),
        (" REPORTS_Dec31_2019.tar.gz ", dt.date(2019, 12, 31)),
        ("reports_feb30_2024.tar.gz", None),
        ("reports_xyz1_2024.tar.gz", None),
        ("reports_jun1_2026.zip", None),
        (None, None),
    ],
)
def test_snapshot_date(spark, name, expected):
    assert one(spark, snapshot_date(F.lit(name))) == expected


@pytest.mark.parametrize(
    "snippet, dangerous",
    [
        ("sudo x", True),
        ("echo sudo", True),
        ("pseudo", False),
        ("harm it", False),
        ("a && b", True),
        ("a $(b)", True),
        ("x\ty", False),
        ("x\x07y", True),
        ("PROTON_LOG=1 %command%", False),
    ],
)
def test_dangerous(spark, snippet, dangerous):
    assert one(spark, snippets.is_dangerous(F.lit(snippet))) is dangerous


def test_words_end_at_any_letter(spark):
    """An accented letter is no word character, so that a phrase may end beside one."""
    rows = spark.createDataFrame([("é skip the introé",), ("skip the introx",)], "t string")
    found = rows.select(snippets.phrase_candidates(F.col("t"), F.lower("t")).alias("c")).collect()
    assert [c["canonical"] for c in found[0]["c"]] == ["skip the intro"]
    assert found[1]["c"] == []
