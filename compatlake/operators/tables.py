"""Stored tables: keys, upserts, replacement, look-ups and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import SYSTEM_FIELDS
from .ratings import report_counts


def with_report_ids(reports: DataFrame) -> DataFrame:
    """Reports without an id get ``source:app:time``."""
    made = F.concat_ws(
        ":", "source_id", F.col("appid").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    given = F.nullif(F.col("source_report_id"), F.lit(""))
    return reports.withColumn("source_report_id", F.coalesce(given, made))


#: What tells reports apart.
REPORT_KEY = ["source_id", "source_report_id"]


def _last(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of the rows with equal keys the one last in order."""
    rest = F.struct(*[c for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(rest, order).alias("r")).select(*keys, "r.*")


def last_system_info(rows: DataFrame) -> DataFrame:
    """Hardware per report, of several the last in input order. A report's id is unique within its source only."""
    return _last(rows, REPORT_KEY, F.col("position")).drop("position")


def with_system_info(reports: DataFrame, info: DataFrame) -> DataFrame:
    """Reports with their hardware; missing texts are empty and missing RAM is 0."""
    found = reports.join(info.select(*REPORT_KEY, *SYSTEM_FIELDS), REPORT_KEY, "left")
    blank = {name: F.lit(0.0) if name == "ram_gb" else F.lit("") for name in SYSTEM_FIELDS}
    return found.withColumns({name: F.coalesce(F.col(name), blank[name]) for name in SYSTEM_FIELDS})


def games_of(reports: DataFrame) -> DataFrame:
    """Games named by their last report in input order."""
    last = F.nullif(F.max_by("title", "position"), F.lit(""))
    unnamed = F.concat(F.lit("Steam App "), F.col("appid").cast("string"))
    return (
        reports.groupBy("appid")
        .agg(last.alias("name"))
        .select("appid", F.coalesce("name", unnamed).alias("name"), F.lit("steam").alias("launcher"))
    )


def upsert_games(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones; blank names and launchers get their defaults."""
    unnamed = F.concat(F.lit("Steam App "), F.col("appid").cast("string"))
    filled = new.select(
        "appid",
        F.coalesce(F.nullif("name", F.lit("")), unnamed).alias("name"),
        F.coalesce(F.nullif("launcher", F.lit("")), F.lit("steam")).alias("launcher"),
    )
    both = old.select("appid", "name", "launcher", F.lit(0).alias("turn")).unionByName(
        filled.withColumn("turn", F.lit(1))
    )
    return _last(both, ["appid"], F.col("turn")).drop("turn")


def upsert_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per source id, the one imported last; of equal times the new one."""
    both = old.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    return _last(both, ["id"], F.struct("imported_at", "turn")).drop("turn")


def run_counts(normalized: DataFrame) -> DataFrame:
    """Counters of an import from one pass over the flagged records."""
    valid = F.col("valid")
    return normalized.groupBy("archive").agg(
        F.count_distinct(F.when(valid, F.col("appid"))).alias("games"),
        F.count_if(valid).alias("report_count"),
        F.count_if(valid & F.col("has_system_info")).alias("system_infos"),
        F.count_if(~valid).alias("skipped_count"),
    )


def kept_runs(runs: DataFrame, sources: DataFrame, kind: str, id_prefix: str) -> DataFrame:
    """Runs left after all earlier ones of a kind of source, or with its id prefix, are removed."""
    of_kind = sources.where(F.col("kind") == kind).select(F.col("id").alias("source_id"))
    return runs.where(~F.col("source_id").startswith(id_prefix)).join(of_kind, "source_id", "left_anti")


def of_kept_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows whose run is still there."""
    return rows.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")


def without_orphans(games: DataFrame, *used: DataFrame) -> DataFrame:
    """Games some table still refers to."""
    ids = reduce(lambda left, right: left.unionByName(right), [table.select("appid") for table in used])
    return games.join(ids, "appid", "left_semi")


def latest_run(runs: DataFrame) -> DataFrame:
    """The run started last."""
    newest = F.max_by(F.struct(*runs.columns), F.struct("started_at", "id"))
    return runs.agg(newest.alias("r")).select("r.*")


def status(sources: DataFrame, runs: DataFrame, games: DataFrame, reports: DataFrame) -> DataFrame:
    """Row counts of the four tables, and the latest run."""
    counted = {"source_count": sources, "import_run_count": runs, "game_count": games, "report_count": reports}
    counts = [table.agg(F.count(F.lit(1)).alias("n")).scalar().alias(name) for name, table in counted.items()]
    run = latest_run(runs)
    return run.select(*counts, *[F.col(c).alias(f"latest_{c}") for c in run.columns])


def find_game(games: DataFrame, appid: int) -> DataFrame:
    return games.where(F.col("appid") == appid)


def with_report_counts(inventory: DataFrame, reports: DataFrame) -> DataFrame:
    """Installed games with how many reports each has."""
    return inventory.join(report_counts(reports), "appid", "left").withColumns(
        {
            "report_count": F.coalesce("report_count", F.lit(0).cast("bigint")),
            "has_reports": F.coalesce(F.col("report_count") > 0, F.lit(False)),
        }
    )
