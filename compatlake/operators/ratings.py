"""Verdict rate and most common runtime per app, over the first window with enough reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.runtime import names_runtime, report_runtime, runtime_key, runtime_label
from ..functions.scores import percent_yes, rating_tooltip, runtime_tooltip, verdict_badge
from .scaling import stored, top_rows

# Windows in order, the reports a window needs, and how many are searched for a spelling.
WINDOWS = (("90 days", 90), ("365 days", 365), ("all time", None))
ENOUGH = 5
SPELLING_ROWS = 50


def in_window(ts: Column, now: Column, days: int | None) -> Column:
    """Is a time inside a window? The cut-off day belongs to it."""
    return F.lit(True) if days is None else F.to_date(ts) >= F.date_sub(F.to_date(now), days)


def report_counts(reports: DataFrame) -> DataFrame:
    return reports.groupBy("appid").agg(F.count(F.lit(1)).alias("report_count"))


def verdict_rates(reports: DataFrame, now: Column) -> DataFrame:
    """Total and yes count per app in its window, from one pass of conditional counts."""
    counts = []
    for at, (_, days) in enumerate(WINDOWS):
        inside = in_window(F.col("ts"), now, days)
        counts.append(F.count_if(inside).alias(f"total_{at}"))
        counts.append(F.count_if(inside & (F.col("verdict") == "yes")).alias(f"yes_{at}"))
    choice: Column | None = None
    last = len(WINDOWS) - 1
    for at, (label, _) in enumerate(WINDOWS):
        row = F.struct(
            F.col(f"total_{at}").alias("total"), F.col(f"yes_{at}").alias("yes"), F.lit(label).alias("window")
        )
        enough = F.col(f"total_{at}") >= ENOUGH
        choice = F.when(enough, row) if choice is None else (choice.when(enough, row) if at < last else choice.otherwise(row))
    return reports.groupBy("appid").agg(*counts).select("appid", choice.alias("w")).select("appid", "w.*")


def badges(rates: DataFrame) -> DataFrame:
    """Percent, badge and tooltip on verdict rates."""
    percent = percent_yes(F.col("yes"), F.col("total"))
    return rates.withColumn("percent", percent).withColumns(
        {
            "badge": verdict_badge(F.col("total"), F.col("percent")),
            "rating_tooltip": rating_tooltip(F.col("total"), F.col("window"), F.col("percent")),
        }
    )


def with_runtime(reports: DataFrame) -> DataFrame:
    """Reports with their runtime; a stored ``runtime`` column is used as it is."""
    if "runtime" in reports.columns:
        return reports
    parsed = reports.withColumn("_document", F.try_parse_json("raw_json"))
    return parsed.withColumn("runtime", report_runtime(F.col("_document"), F.col("proton_version"))).drop("_document")


def common_runtimes(reports: DataFrame, now: Column) -> DataFrame:
    """Most common runtime among yes reports per app; of equally common ones the smallest.

    ``total`` counts reports that name no runtime too, the window test does not.
    """
    yes = with_runtime(reports).where(F.col("verdict") == "yes").withColumn("key", runtime_key(F.col("runtime")))
    yes = yes.select("appid", "key", "runtime", "ts", "source_report_id")
    if "runtime" not in reports.columns:
        # the JSON of a report is parsed once for both of what follows
        yes = stored(yes)
    named = names_runtime(F.col("key"))
    per_key = yes.groupBy("appid", "key").agg(
        *[F.count_if(in_window(F.col("ts"), now, days)).alias(f"n_{at}") for at, (_, days) in enumerate(WINDOWS)]
    )
    per_app = []
    for at in range(len(WINDOWS)):
        n = F.col(f"n_{at}")
        per_app += [
            F.sum(n).alias(f"total_{at}"),
            F.sum(F.when(named, n).otherwise(F.lit(0))).alias(f"named_{at}"),
            F.min(F.when(named & (n > 0), F.struct((-n).alias("minus"), F.col("key").alias("key")))).alias(f"best_{at}"),
        ]
    choice: Column | None = None
    last = len(WINDOWS) - 1
    for at, (label, days) in enumerate(WINDOWS):
        row = F.struct(
            F.col(f"best_{at}.key").alias("raw_value"),
            (-F.col(f"best_{at}.minus")).alias("count"),
            F.col(f"total_{at}").alias("total"),
            F.lit(label).alias("window"),
            F.lit(days).cast("int").alias("days"),
        )
        enough = F.col(f"named_{at}") >= ENOUGH
        choice = F.when(enough, row) if choice is None else (choice.when(enough, row) if at < last else choice.otherwise(row))
    chosen = (
        per_key.groupBy("appid")
        .agg(*per_app)
        .select("appid", choice.alias("w"))
        .select("appid", "w.*")
        .where(F.col("raw_value").isNotNull())
    )
    newest = top_rows(
        yes,
        ["appid"],
        [F.col("ts").desc(), F.col("source_report_id").desc()],
        SPELLING_ROWS,
    )
    spelled = newest.groupBy("appid", F.col("key").alias("raw_value")).agg(
        F.min_by("runtime", "rank").alias("spelling"), F.max("ts").alias("newest")
    )
    inside = F.col("days").isNull() | (F.to_date("newest") >= F.date_sub(F.to_date(now), F.col("days")))
    return chosen.join(spelled, ["appid", "raw_value"], "left").select(
        "appid",
        runtime_label(F.coalesce(F.when(inside, F.col("spelling")), F.col("raw_value"))).alias("value"),
        "raw_value",
        "count",
        "total",
        "window",
        runtime_tooltip(F.col("count"), F.col("total"), F.col("window")).alias("runtime_tooltip"),
    )
