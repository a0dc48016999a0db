"""Reports compared with the machines of those who ask, and their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scores
from ..functions.hardware import normalized_profile
from ..functions.text import text_or_empty
from ..schemas import NORM_COLUMNS
from .scaling import HOT_SHARE, number_rows, sliced_join, stored, top_rows

#: Requests of one app and machine travel in blocks of at most so many (a power of two).
_BLOCK_BITS = 10
#: Rows that one task makes when reports meet requests.
MEETINGS = 20_000_000


def with_hardware(df: DataFrame) -> DataFrame:
    """Add the nine comparison categories to reports or machines."""
    column = lambda name: F.col(name) if name in df.columns else F.lit("")
    optional = lambda name: F.col(name) if name in df.columns else None
    return df.withColumns(
        normalized_profile(
            column("gpu_vendor"),
            column("gpu_model"),
            column("gpu_driver"),
            column("cpu"),
            F.col("ram_gb"),
            column("distro"),
            column("kernel"),
            column("session_type"),
            column("desktop"),
            optional("distro_id"),
            optional("distro_id_like"),
        )
    )


def asked(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requests ``(profile_id, appid)`` with the comparable categories of the machine, as one value; worked out once."""
    machine = F.struct(*[scores.comparable(F.col(name)).alias(name) for name in NORM_COLUMNS])
    machines = profiles.select("profile_id", machine.alias("machine"))
    return stored(requests.select("profile_id", "appid").join(machines, "profile_id"))


def similarity_columns() -> tuple[dict[str, Column], dict[str, Column]]:
    """User and report sides of a compared row."""
    return {n: F.col("machine")[n] for n in NORM_COLUMNS}, {n: F.col("hardware")[n] for n in NORM_COLUMNS}


def with_scores(reports: DataFrame, now: Column) -> DataFrame:
    """Add what a report scores whoever asks: age, recency, freshness and quality."""
    return reports.withColumns(
        {
            "recency": scores.recency(F.col("ts"), now),
            "age_days": scores.age_days(F.col("ts"), now),
            "freshness": scores.freshness(F.col("ts"), now),
            "quality": scores.quality(F.col("rating"), F.col("launch_options"), F.col("notes"), F.col("verdict")),
        }
    )


def scored(reports: DataFrame, now: Column, keep: list[str]) -> DataFrame:
    """Reports with their own scores and comparable hardware; columns not in ``keep`` are left behind."""
    hardware = F.struct(*[scores.comparable(F.col(name)).alias(name) for name in NORM_COLUMNS])
    columns = ["appid", "source_id", "source_report_id", "position", "ts", "recency", "age_days", "freshness", "quality"]
    return with_scores(reports, now).select(*dict.fromkeys([*columns, *keep]), hardware.alias("hardware"))


def alike(tuples: DataFrame, machines: DataFrame) -> DataFrame:
    """Similarity of every machine that asks for an app to every kind of hardware ``(appid, hardware)`` reported on it."""
    machines = machines.select("appid", "machine").distinct()
    joined = sliced_join(tuples, machines, ["appid"], ["hardware"])
    # stored, since it would otherwise be worked out for every row that meets it
    return stored(joined.withColumn("similarity", scores.similarity(*similarity_columns())))


def compare_machines(
    rows: DataFrame, machines: DataFrame, more: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Each scored report of an asked-for app with its similarity to each distinct asking machine and its score.

    Similarity is worked out per kind of hardware, of which an app has few, not per report; so is what ``more`` adds.
    """
    pairs = alike(rows.select("appid", "hardware").distinct(), machines)
    pairs = stored(more(pairs)) if more else pairs
    score = scores.rank_score(F.col("recency"), F.col("similarity"), F.col("quality"))
    return rows.join(pairs, ["appid", "hardware"]).withColumn("score", score)


def for_requests(rows: DataFrame, machines: DataFrame) -> DataFrame:
    """What was worked out per app and machine, for every request; ``machines`` comes from ``asked``."""
    return rows.join(machines, ["appid", "machine"])


def asked_for(rows: DataFrame, machines: DataFrame) -> DataFrame:
    """Scored reports of the apps that are asked for, worked out once."""
    return stored(rows.join(machines.select("appid").distinct(), "appid", "left_semi"))


def request_blocks(machines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apps and asking machines, numbered, and their requests in blocks.

    Askers: appid, machine, asker (a number) and requests. Blocks: asker and profiles, at most 1,024 of them: requests are
    numbered by all tasks, so one app and machine that very many ask for is many blocks, all but the last of them full.
    ``machines`` comes from ``asked``.
    """
    askers = machines.groupBy("appid", "machine").agg(F.count(F.lit(1)).alias("requests"))
    askers = stored(askers.withColumn("asker", F.monotonically_increasing_id()))
    placed = stored(machines.join(askers, ["appid", "machine"]).select("asker", "profile_id"))
    placed = number_rows(placed, ["asker"], [F.col("profile_id").asc()], "_number")
    placed = placed.withColumn("_block", F.shiftright(F.col("_number") - 1, _BLOCK_BITS))
    return askers, stored(placed.groupBy("asker", "_block").agg(F.collect_list("profile_id").alias("profiles")).drop("_block"))


def meet_requests(
    rows: DataFrame, blocks: DataFrame, key: str, meetings: DataFrame, said: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Rows, told apart by a number ``_row``, for each of the ``profiles`` in the blocks of their key.

    ``meetings`` has the keys and the number of rows they make (``_rows``): slices and tasks are as many as these ask for,
    however few the rows and blocks are. A row meets a block of requests at once and is repeated only at the end; what
    ``said`` adds is worked out before that.
    """
    made = meetings.agg(F.sum("_rows")).first()[0] or 0
    tasks = max(1, min(-(-made // MEETINGS), int(4 / HOT_SHARE)))
    tasks = max(tasks, rows.sparkSession.sparkContext.defaultParallelism)
    met = sliced_join(rows, blocks, [key], ["_row"], meetings, tasks=tasks)
    met = said(met) if said else met
    return met.withColumn("profile_id", F.explode("profiles")).drop("profiles", "_row", key)


#: What tells single reports of an app and machine apart.
_OWN = ["appid", "machine", "source_report_id", "source_id", "position"]


def _read(df: DataFrame, columns: list[Column | str]) -> set[str]:
    """Names in ``df`` that the columns are worked out from."""
    found = df.select(*columns)._jdf.queryExecution().analyzed().references().toSeq()
    return {found.apply(n).name() for n in range(found.size())}


def compare_for_requests(
    rows: DataFrame,
    machines: DataFrame,
    columns: list[Column | str] | None,
    more: Callable[[DataFrame], DataFrame] | None = None,
    derived: dict[str, Column] | None = None,
) -> DataFrame:
    """Scored reports with their likeness to the asking machine and their score, for every request.

    Likeness and what ``more`` adds are worked out per kind (app and hardware) and machine and meet the requests in
    blocks; reports meet only these, so nothing is stored or moved per report and machine. Of ``columns`` each
    is worked out per report, or per kind and machine, where that is enough; the others, with score and what is
    ``derived`` for them, once per report and block. Without ``columns`` all there are are handed on. ``machines`` comes
    from ``asked``.
    """
    askers, blocks = request_blocks(machines)
    rows = asked_for(rows, machines)
    kinds = rows.groupBy("appid", "hardware").agg(F.count(F.lit(1)).alias("_reports"))
    kinds = stored(kinds.withColumn("_kind", F.monotonically_increasing_id()))
    pairs = alike(kinds, machines).join(askers.withColumnRenamed("requests", "_requests"), ["appid", "machine"])
    pairs = more(pairs) if more else pairs
    derived = {"score": scores.rank_score(F.col("recency"), F.col("similarity"), F.col("quality")), **(derived or {})}
    own = {"rows": rows.drop("hardware"), "pairs": pairs.drop("appid", "asker", "_kind", "_reports", "_requests")}
    both = own["rows"].crossJoin(own["pairs"])  # only to look names up
    full = both.withColumns(derived)
    sides = [next((side for side in own if _read(full, [column]) <= {*own[side].columns}), "") for column in columns or []]
    mixed = [column for column, side in zip(columns or [], sides, strict=True) if not side]
    used = _read(full, mixed)
    if columns is not None:
        derived = {name: column for name, column in derived.items() if name in used}
    used |= {*_OWN, *_read(both, [*derived.values()])}
    own_names = {side: [name for name in df.columns if columns is None or name in used] for side, df in own.items()}
    # columns made on one side go by a number until the end
    made: dict[str, list[Column]] = {side: [] for side in own}
    final: list[Column | str] = []
    for n, (column, side) in enumerate(zip(columns or [], sides, strict=True)):
        if side:
            made[side].append((F.col(column) if isinstance(column, str) else column).alias(f"_made_{n}"))
        final.append(F.col(f"_made_{n}").alias(own[side].select(column).columns[0]) if side else column)
    numbered = rows.join(kinds.select("appid", "hardware", "_kind"), ["appid", "hardware"])
    numbered = stored(numbered.select("_kind", F.monotonically_increasing_id().alias("_row"), *own_names["rows"], *made["rows"]))
    pairs = stored(pairs.select("_kind", "asker", "_reports", "_requests", *own_names["pairs"], *made["pairs"]))
    meetings = stored(pairs.groupBy("_kind").agg(F.sum(F.col("_reports") * F.col("_requests")).alias("_rows")))
    asking = pairs.drop("_reports", "_requests").join(blocks, "asker").drop("asker")

    def handed_on(met: DataFrame) -> DataFrame:
        met = met.withColumns(derived) if derived else met
        return met.select("profiles", *_OWN, *final) if columns is not None else met

    return meet_requests(numbered, asking, "_kind", meetings, handed_on)


def compare(
    reports: DataFrame, requests: DataFrame, profiles: DataFrame, now: Column, keep: list[str], columns: list[Column | str] | None = None
) -> DataFrame:
    """Each asked-for report with its similarity to the asking machine and its score, for every request.

    ``columns`` are worked out before requests are met one by one, and only they are handed on; without them all are.
    """
    machines = asked(requests, profiles)
    return compare_for_requests(scored(reports, now, keep), machines, columns)


def compare_explained(
    reports: DataFrame,
    requests: DataFrame,
    profiles: DataFrame,
    now: Column,
    keep: list[str],
    columns: Callable[[], list[Column | str]],
) -> DataFrame:
    """``columns`` of each asked-for report, explained, for every request.

    Lists and sentence are worked out per kind of hardware and machine, each reason per report or per kind and machine; they
    are put together per report and block of requests.
    """
    machines = asked(requests, profiles)
    first, later = _report_reasons()
    rows = scored(reports, now, keep).withColumns({"_first_said": first, "_later_said": later})
    likeness = scores.similarity_reason(F.col("similarity"), F.col("similarity_summary"))
    more = lambda pairs: with_details(pairs).withColumn("_likeness_said", likeness)
    reasons = scores.reasons(F.col("_first_said"), F.col("_likeness_said"), F.col("_later_said"))
    return compare_for_requests(rows, machines, columns(), more, {"reasons": reasons})


def rank_order() -> list[Column]:
    return [
        F.col("score").desc(),
        F.col("ts").desc(),
        F.col("source_report_id").asc(),
        F.col("source_id").asc(),
        F.col("position").asc(),
    ]


def with_details(pairs: DataFrame) -> DataFrame:
    """Add the similarity lists and sentence to kinds of hardware and machines."""
    df = pairs.withColumns(scores.similarity_details(*similarity_columns()))
    return df.withColumn(
        "similarity_summary", scores.similarity_summary(F.col("matches"), F.col("mismatches"), F.col("unknowns"))
    )


def with_reasons(compared: DataFrame) -> DataFrame:
    """Add the reason strings to reports with ``similarity_summary``."""
    likeness = scores.similarity_reason(F.col("similarity"), F.col("similarity_summary"))
    first, later = _report_reasons()
    return compared.withColumn("reasons", scores.reasons(first, likeness, later))


def _report_reasons() -> tuple[Column, Column]:
    launch_options = text_or_empty(F.col("launch_options"))
    return scores.report_reasons(F.col("freshness"), F.col("age_days"), F.col("recency"), F.col("quality"), launch_options)


def explain(compared: DataFrame) -> DataFrame:
    """Add the similarity lists and sentence and the reason strings."""
    return with_reasons(with_details(compared))


def score_levels(rows: DataFrame, machines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of reports alike for every machine, and for each machine the cells that score the same.

    Cells: appid, hardware, recency, quality, cell (a number) and reports. Levels: appid, machine, score, cells (sorted
    numbers), reports and before, the number of the app's reports that score higher: sums over a histogram of at most 1,001 scores.
    """
    cells = rows.groupBy("appid", "hardware", "recency", "quality").agg(F.count(F.lit(1)).alias("reports"))
    cells = stored(cells.withColumn("cell", F.monotonically_increasing_id()))
    pairs = alike(cells.select("appid", "hardware").distinct(), machines)
    score = scores.rank_score(F.col("recency"), F.col("similarity"), F.col("quality"))
    scored_cells = sliced_join(cells, pairs, ["appid", "hardware"], ["cell"]).withColumn("score", score)
    levels = scored_cells.groupBy("appid", "machine", "score").agg(
        F.sum("reports").alias("reports"), F.array_sort(F.collect_list("cell")).alias("cells")
    )
    higher = Window.partitionBy("appid", "machine").orderBy(F.col("score").desc())
    higher = F.sum("reports").over(higher.rowsBetween(Window.unboundedPreceding, -1))
    return cells, stored(levels.withColumn("before", F.coalesce(higher, F.lit(0))))


def rank_reports(rows: DataFrame, machines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All scored reports of asked-for apps with score and rank for every request: score, then newest, then id.

    A report's rank is the number of reports that score higher, counted per cell, and its place among those that score
    the same. Which cells score the same is a set of cells that many machines share, so reports are numbered once
    for each such set, not for each machine, and meet the requests only then, in blocks. Of the reports' columns ``keep`` are
    handed on, without it all. ``machines`` comes from ``asked``.
    """
    rows = asked_for(rows, machines)
    cells, levels = score_levels(rows, machines)
    ties = levels.select("appid", "cells", F.col("reports").alias("_reports")).distinct()
    ties = stored(ties.withColumn("tie", F.monotonically_increasing_id()))
    members = ties.select("tie", F.explode("cells").alias("cell")).join(cells.drop("reports"), "cell").drop("cell")
    kind, spread = ["appid", "hardware", "recency", "quality"], ["source_report_id", "source_id", "position"]
    alike_rows = sliced_join(rows, members, kind, spread, cells.select(*kind, F.col("reports").alias("_rows")))
    if keep is not None:
        alike_rows = alike_rows.select("tie", *dict.fromkeys([*spread, "ts", *keep]))
    placed = number_rows(alike_rows, ["tie"], rank_order()[1:], "among")
    placed = placed.withColumn("_row", F.xxhash64(*spread))
    askers, blocks = request_blocks(machines)
    asking = levels.join(ties, ["appid", "cells"]).join(askers, ["appid", "machine"])
    asking = stored(asking.select("tie", "machine", "score", "before", "_reports", "asker", "requests"))
    meetings = asking.groupBy("tie").agg(F.sum(F.col("_reports") * F.col("requests")).alias("_rows"))
    asking = asking.join(blocks, "asker").select("tie", "machine", "score", "before", "profiles")
    rank = lambda met: met.withColumn("rank", F.col("before") + F.col("among")).drop("before", "among")
    return meet_requests(placed, asking, "tie", stored(meetings), rank)


def best_reports(rows: DataFrame, machines: DataFrame, limit: int) -> DataFrame:
    """The best scored reports per app and machine.

    Reports of one hardware, recency and quality score alike for any machine, so the first ``limit`` of each such cell
    are enough; only these meet the machines.
    """
    cell = ["appid", "hardware", "recency", "quality"]
    # stored, since kinds of hardware are read from it as well
    few = stored(top_rows(rows, cell, rank_order()[1:], limit, "_rank").drop("_rank"))
    return top_rows(compare_machines(few, machines), ["appid", "machine"], rank_order(), limit)


def newest_first(reports: DataFrame) -> DataFrame:
    """Reports numbered per app, newest first, larger id first among equals."""
    ties = [F.col(column).desc() for column in ("source_id", "position") if column in reports.columns]
    return number_rows(reports, ["appid"], [F.col("ts").desc(), F.col("source_report_id").desc(), *ties])


def freshness_tally(reports: DataFrame, now: Column) -> DataFrame:
    return reports.groupBy(scores.freshness(F.col("ts"), now).alias("freshness")).agg(
        F.count(F.lit(1)).alias("reports")
    )


def age_warnings(reports: DataFrame, now: Column) -> DataFrame:
    """Stale and historical counts per app, and the warnings they call for."""
    fresh = scores.freshness(F.col("ts"), now)
    counted = reports.groupBy("appid").agg(
        F.count(F.lit(1)).alias("reports"),
        F.count_if(fresh == "stale").alias("stale"),
        F.count_if(fresh == "historical").alias("historical"),
    )
    stale, historical = F.col("stale"), F.col("historical")
    warnings = F.array_compact(
        F.array(
            F.when(
                (stale > 0) & (stale * 3 >= F.col("reports")),
                F.format_string("%d stale reports dominate; data may be outdated.", stale),
            ),
            F.when(
                historical > 0,
                F.format_string("%d reports older than 2 years (historical context only).", historical),
            ),
        )
    )
    return counted.withColumn("warnings", warnings)
