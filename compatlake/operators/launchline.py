"""Launch lines composed of chosen snippets and what is set already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules, snippets
from ..functions.text import strip, text_or_empty, words
from .scaling import stored

NO_COMMAND = "Existing options had no %command%; appended as game arguments."
CONFLICTING = "Preview includes conflicting environment assignments."
_PREFIX, _SUFFIX = 0, 1


def _tokens(section: int, pieces: Column) -> Column:
    return F.transform(
        pieces,
        lambda token, at: F.struct(
            F.lit(section).alias("section"), at.cast("int").alias("at"), token.alias("token")
        ),
    )


def split_line(line: Column) -> Column:
    """Tokens before and after the command marker, each with its section and place."""
    return F.concat(
        _tokens(_PREFIX, words(snippets.before_command(line))), _tokens(_SUFFIX, words(snippets.after_command(line)))
    )


def snippet_tokens(snippet: Column) -> Column:
    """Tokens of a chosen snippet; one without a marker is one token, before it only if it sets or wraps."""
    leading = snippets.is_env_assignment(snippet) | snippets.is_wrapper(snippet)
    return (
        F.when(snippets.has_command(snippet), split_line(snippet))
        .when(leading, _tokens(_PREFIX, F.array(snippet)))
        .otherwise(_tokens(_SUFFIX, F.array(snippet)))
    )


def existing_tokens(existing: Column) -> Column:
    """Tokens of the options set already; without a marker they are one game argument."""
    return (
        F.when(snippets.has_command(existing), split_line(existing))
        .when(existing != "", _tokens(_SUFFIX, F.array(existing)))
        .otherwise(_tokens(_SUFFIX, F.array().cast("array<string>")))
    )


def judged(selected: DataFrame) -> DataFrame:
    """Chosen snippets ``(line_id, pos, id, kind, snippet)`` with whether they may be used."""
    copyable, dangerous = snippets.is_copyable_kind(F.col("kind")), snippets.is_dangerous(F.col("snippet"))
    return selected.withColumns({"applied": copyable & ~dangerous, "dangerous": copyable & dangerous})


def line_tokens(lines: DataFrame, judged_selected: DataFrame) -> DataFrame:
    """Distinct tokens per line: what comes first in the prefix, then in the suffix, stays."""
    existing = strip(text_or_empty(F.col("existing")))
    parts = lines.select("line_id", F.lit(-1).cast("bigint").alias("pos"), existing_tokens(existing).alias("t"))
    chosen = judged_selected.where(F.col("applied")).select(
        "line_id", F.col("pos").cast("bigint").alias("pos"), snippet_tokens(F.col("snippet")).alias("t")
    )
    tokens = parts.unionByName(chosen).select("line_id", "pos", F.explode("t").alias("t")).select(
        "line_id", "pos", "t.*"
    )
    canon = F.lower(snippets.trim_outer_quotes(F.col("token")))
    first = F.min(F.struct("section", "pos", "at", "token"))
    return (
        tokens.groupBy("line_id", canon.alias("canon"))
        .agg(first.alias("first"))
        .select("line_id", "first.*")
        .withColumn("is_env", (F.col("section") == _PREFIX) & snippets.is_env_assignment(F.col("token")))
    )


def env_conflicts(tokens: DataFrame) -> DataFrame:
    """Variables set to more than one value in a line."""
    assigned = tokens.where(F.col("is_env")).select("line_id", snippets.split_env(F.col("token")).alias("e"))
    values = assigned.where(F.col("e").isNotNull()).groupBy("line_id", F.col("e.name").alias("name"))
    return (
        values.agg(F.sort_array(F.collect_set("e.value")).alias("values"))
        .where(F.size("values") > 1)
        .select(
            "line_id",
            "name",
            F.concat(F.lit("Conflicting "), "name", F.lit(": "), F.array_join("values", ", ")).alias("conflict"),
        )
    )


def _in_order(value: Column, *order: Column) -> Column:
    """Values collected in order; NULLs are left out."""
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*order, value.alias("_value")))))
    return F.transform(rows, lambda row: row["_value"])


def compose(lines: DataFrame, selected: DataFrame) -> DataFrame:
    """Launch line, used and skipped snippets, warnings and conflicts of every line.

    ``lines`` holds ``(line_id, existing)``, ``selected`` the chosen snippets. Repeats go before
    anything is gathered; what is gathered per line is the line itself.
    """
    items = judged(selected)
    tokens = stored(line_tokens(lines, items))
    section = F.when(F.col("is_env"), F.lit(0)).when(F.col("section") == _PREFIX, F.lit(1)).otherwise(F.lit(3))
    placed = tokens.select("line_id", section.alias("section"), "pos", "at", "token")
    markers = lines.select(
        "line_id",
        F.lit(2).alias("section"),
        F.lit(0).cast("bigint").alias("pos"),
        F.lit(0).alias("at"),
        F.lit(rules.COMMAND).alias("token"),
    )
    previews = (
        placed.unionByName(markers)
        .groupBy("line_id")
        .agg(F.array_join(_in_order(F.col("token"), F.col("section"), F.col("pos"), F.col("at")), " ").alias("preview"))
    )
    fates = items.groupBy("line_id").agg(
        _in_order(F.when(F.col("applied"), F.col("id")), F.col("pos")).alias("applied"),
        _in_order(F.when(~F.col("applied"), F.col("id")), F.col("pos")).alias("skipped"),
        _in_order(
            F.when(
                F.col("dangerous"), F.concat(F.lit("Skipped "), F.col("id"), F.lit(": contains dangerous tokens."))
            ),
            F.col("pos"),
        ).alias("_refused"),
    )
    clashes = (
        env_conflicts(tokens).groupBy("line_id").agg(_in_order(F.col("conflict"), F.col("name")).alias("conflicts"))
    )
    empty = F.array().cast("array<string>")
    existing = strip(text_or_empty(F.col("existing")))
    unmarked = (existing != "") & ~snippets.has_command(existing)
    conflicts = F.coalesce("conflicts", empty)
    warnings = F.concat(
        F.when(unmarked, F.array(F.lit(NO_COMMAND))).otherwise(empty),
        F.coalesce("_refused", empty),
        F.when(F.size(conflicts) > 0, F.array(F.lit(CONFLICTING))).otherwise(empty),
    )
    return (
        lines.join(previews, "line_id")
        .join(fates, "line_id", "left")
        .join(clashes, "line_id", "left")
        .select(
            "line_id",
            existing.alias("existing"),
            "preview",
            snippets.display_case(F.col("preview")).alias("shown"),
            F.coalesce("applied", empty).alias("applied"),
            F.coalesce("skipped", empty).alias("skipped"),
            warnings.alias("warnings"),
            conflicts.alias("conflicts"),
        )
    )


def current_options(existing: DataFrame) -> DataFrame:
    """What is set already as suggestions of the request, for ``(profile_id, appid, existing)``."""
    prefix = F.when(snippets.has_command(F.col("existing")), snippets.before_command(F.col("existing")))
    tokens = existing.select(
        "profile_id",
        "appid",
        F.posexplode(F.filter(F.split(prefix, r"\s+"), lambda t: (t != "") & (t != rules.COMMAND))).alias("at", "snippet"),
    )
    labelled = snippets.with_meta(tokens, F.col("snippet"))
    label = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.col("snippet"))
    return labelled.select(
        "profile_id",
        "appid",
        "at",
        F.concat(F.lit("existing-"), "snippet").alias("id"),
        F.lit("env_var").alias("kind"),
        "snippet",
        F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 2147483647)).alias("label"),
        F.coalesce(F.nullif(F.col("description"), F.lit("")), F.lit("Currently set in Steam")).alias("description"),
        F.lit("Current").alias("category"),
        F.lit(1).cast("bigint").alias("occurrences"),
        F.lit(1.0).alias("similarity"),
        F.lit(0.0).alias("recency"),
        F.lit("high").alias("confidence"),
    )
