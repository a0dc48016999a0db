"""Recommendations and dashboard rows for every request at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scores
from ..functions.snippets import is_copyable_kind
from ..functions.text import strip, text_or_empty
from ..operators import mining, ranking, ratings
from ..operators.scaling import stored

CITATIONS, CITED_CHARACTERS = 5, 180


def citations(rows: DataFrame, machines: DataFrame, limit: int = CITATIONS) -> DataFrame:
    """The best reports of each app and asking machine, as they are cited."""
    return ranking.best_reports(rows, machines, limit).select(
        "machine",
        "appid",
        "rank",
        "source_id",
        "source_report_id",
        "ts",
        "snippet",
        "rating",
        "freshness",
        "similarity",
    )


def citable(reports: DataFrame) -> DataFrame:
    """Reports with the part of their notes that is cited."""
    return reports.withColumn("snippet", F.substring(text_or_empty(F.col("notes")), 1, CITED_CHARACTERS))


def summary(label: str) -> Column:
    """The sentence for a request: what to try first and on what evidence."""
    appid = F.col("appid").cast("string")
    name = F.coalesce(F.nullif(strip(F.col("name")), F.lit("")), F.concat(F.lit("appid "), appid))
    action = F.when(is_copyable_kind(F.col("best_kind")), F.lit("launch option suggestion")).otherwise(F.lit("suggestion"))
    rating = F.coalesce(F.nullif("top_rating", F.lit("")), F.lit("?"))
    return (
        F.when(F.col("reports") == 0, F.concat(F.lit(f"No imported {label} reports for "), name, F.lit(".")))
        .when(
            F.col("best_snippet").isNull(),
            F.format_string("No actionable suggestions for %s from %d reports.", name, F.col("reports")),
        )
        .otherwise(
            F.format_string(
                'Start with %s "%s" (%s confidence). Top evidence is a %s report from %s rated %s with %d%% system similarity.',
                action,
                F.col("best_snippet"),
                F.col("best_confidence"),
                F.col("top_freshness"),
                F.coalesce(F.date_format("top_ts", "yyyy-MM-dd"), F.lit("unknown date")),
                rating,
                (F.col("top_similarity") * 100).cast("int"),
            )
        )
    )


def suggested(reports: DataFrame, requests: DataFrame, profiles: DataFrame, now: Column) -> DataFrame:
    """All ranked suggestions of every request, as rows beside its recommendation."""
    machines = ranking.asked(requests, profiles)
    return ranking.for_requests(mining.rank_suggestions(stored(mining.suggestions(reports, machines, now))), machines)


def recommendations(
    games: DataFrame, reports: DataFrame, requests: DataFrame, profiles: DataFrame, now: Column, label: str = "community"
) -> DataFrame:
    """Summary, warnings, citations and shown suggestions of every request.

    What is gathered per request is bounded: five citations and the fifteen suggestions that are shown, named so.
    All suggestions (``suggested``) and ranked reports (``rank_reports``) are rows of tables beside this one.
    Everything is worked out once per app and distinct machine, and handed to the requests at the end.
    """
    machines = ranking.asked(requests, profiles)
    key = ["appid", "machine"]
    wanted = citable(reports).join(machines.select("appid").distinct(), "appid", "left_semi")
    cited = citations(ranking.scored(wanted, now, ["rating", "snippet"]), machines)
    cite = F.struct("rank", "source_id", "source_report_id", "ts", "snippet")
    top = lambda column: F.max(F.when(F.col("rank") == 1, F.col(column))).alias(f"top_{column}")
    evidence = cited.groupBy(*key).agg(
        F.array_sort(F.collect_list(cite)).alias("citations"),
        top("ts"),
        top("rating"),
        top("freshness"),
        top("similarity"),
    )
    merged = stored(mining.suggestions(reports, machines, now))
    best = mining.best_suggestions(merged, 1).select(
        *key,
        F.col("kind").alias("best_kind"),
        F.col("snippet").alias("best_snippet"),
        F.col("confidence").alias("best_confidence"),
    )
    listed = F.struct("rank", "id", "kind", "snippet", "label", "category", "confidence", "occurrences")
    shown = mining.shown_suggestions(merged).groupBy(*key).agg(
        F.array_sort(F.collect_list(listed)).alias("shown_suggestions")
    )
    ages = ranking.age_warnings(reports, now)
    full = (
        machines.join(games.select("appid", "name"), "appid", "left")
        .join(ages, "appid", "left")
        .join(evidence, key, "left")
        .join(best, key, "left")
        .join(shown, key, "left")
        .withColumn("reports", F.coalesce("reports", F.lit(0)))
    )
    return full.select(
        "profile_id",
        "appid",
        "name",
        "reports",
        summary(label).alias("summary"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        "citations",
        "shown_suggestions",
        F.col("top_similarity").alias("best_similarity"),
        F.lit("rules").alias("generated_by"),
    )


def offered(current: DataFrame, shown: DataFrame) -> DataFrame:
    """What is offered per request: options that are set already first, then the shown suggestions.

    ``current`` comes from ``launchline.current_options``; ``place`` counts within the two parts.
    """
    columns = ["profile_id", "appid", "id", "kind", "snippet", "label", "category", "confidence"]
    first = current.select(F.lit("current").alias("part"), F.col("at").cast("bigint").alias("place"), *columns)
    return first.unionByName(shown.select(F.lit("suggested").alias("part"), F.col("rank").cast("bigint").alias("place"), *columns))


def app_rows(reports: DataFrame, now: Column) -> DataFrame:
    """Report count, verdict badge and common runtime of every app."""
    rates = ratings.badges(ratings.verdict_rates(reports, now))
    runtimes = ratings.common_runtimes(reports, now).select(
        "appid", F.col("value").alias("runtime"), "runtime_tooltip"
    )
    return ratings.report_counts(reports).join(rates, "appid").join(runtimes, "appid", "left")


def dashboard(
    games: DataFrame, reports: DataFrame, requests: DataFrame, profiles: DataFrame, now: Column, label: str = "community"
) -> DataFrame:
    """What is shown for every request: badge, runtime, counts, summary and hardware label."""
    advice = recommendations(games, reports, requests, profiles, now, label)
    rows = app_rows(reports, now)
    return advice.join(rows, "appid", "left").select(
        "profile_id",
        "appid",
        F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("App "), F.col("appid").cast("string"))).alias("title"),
        "badge",
        "rating_tooltip",
        "runtime",
        "runtime_tooltip",
        "reports",
        "summary",
        "warnings",
        F.size(F.coalesce("shown_suggestions", F.array())).alias("shown"),
        scores.similarity_label(F.coalesce("best_similarity", F.lit(0.0))).alias("hardware"),
    )
