"""Catalogue of snapshot archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import strip, text_or_empty

# Form of a snapshot's file name and its month names.
NAME_FORM = r"(?i)^reports_([a-z]{3})(\d{1,2})_(\d{4})\.tar\.gz$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def snapshot_date(name: Column) -> Column:
    """Date in a snapshot's file name; NULL for other names and impossible dates."""
    bare = strip(text_or_empty(name))
    part = lambda at: F.regexp_extract(bare, NAME_FORM, at)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(1)))
    text = F.concat_ws("-", part(3), month.cast("string"), part(2))
    return F.when(bare.rlike(NAME_FORM) & (month > 0), F.try_to_date(text, "yyyy-M-d"))


def snapshots(listing: DataFrame, base_url: str) -> DataFrame:
    """Snapshots in a listing ``(name, type, download_url, size)``: files with a date in their name."""
    dated = listing.where(text_or_empty(F.col("type")).isin("", "file")).withColumn("date", snapshot_date(F.col("name")))
    url = F.coalesce(F.nullif("download_url", F.lit("")), F.concat(F.lit(base_url + "/"), F.col("name")))
    return dated.where(F.col("date").isNotNull()).select(
        F.col("name").alias("filename"), "date", url.alias("url"), F.coalesce("size", F.lit(0).cast("bigint")).alias("size")
    )


def latest_snapshot(found: DataFrame) -> DataFrame:
    """The newest snapshot; of one date the name last in order."""
    return found.agg(F.max(F.struct("date", "filename", "url", "size")).alias("s")).select(
        "s.filename", "s.date", "s.url", "s.size"
    )


def newest_first(found: DataFrame) -> DataFrame:
    return found.orderBy(F.col("date").desc(), F.col("filename").desc())
