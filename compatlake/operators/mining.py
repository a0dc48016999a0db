"""Suggestions mined from report text: candidates, counts, confidence, merging and order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scores, snippets
from ..functions.rules import COMMAND
from ..functions.text import text_or_empty
from ..schemas import NORM_COLUMNS
from .ranking import alike
from .scaling import number_rows, sliced_join, stored, top_rows

SHOWN = 15


def mine(reports: DataFrame) -> DataFrame:
    """One row per candidate of a report. Each distinct text is scanned once, however many reports have it.

    Texts are counted first; those that hold a candidate then meet their reports, and a text of very many reports, such as
    a common launch line, is met in slices.
    """
    known = [scores.comparable(F.col(name)).alias(name) for name in NORM_COLUMNS if name in reports.columns]
    machine = [F.struct(*known).alias("hardware")] if known else []
    said = ["notes", "launch_options"]
    rows = reports.select(
        "appid",
        F.concat_ws(":", "source_id", "source_report_id").alias("source_key"),
        "ts",
        *machine,
        *[text_or_empty(F.col(name)).alias(name) for name in said],
    )
    counted = stored(rows.groupBy(*said).agg(F.count(F.lit(1)).alias("_rows")))
    texts = counted.withColumn("_text", snippets.search_text(F.col("notes"), F.col("launch_options")))
    texts = texts.withColumn("_low", F.lower("_text"))
    found = snippets.candidates(F.col("_text"), F.col("_low"), F.col("launch_options")).alias("_found")
    texts = stored(texts.select(*said, found).where(F.size("_found") > 0))
    kept = [c for c in rows.columns if c not in said]
    mined_ = sliced_join(rows, texts, said, ["source_key"], counted).select(*kept, F.explode("_found").alias("c"))
    return mined_.select(*kept, "c.kind", "c.canonical")


def tally(candidates: DataFrame) -> DataFrame:
    """Candidates counted per app, kind and snippet, and per kind of machine that reported them.

    Rows with ``hardware`` NULL hold the counts, the others one machine category each; both come
    from one pass. Distinct sources are counted after a shuffle on the source too, so an app
    with very many reports spreads over tasks. Nothing here depends on the time of asking: the tally can be kept.
    """
    whole = ["appid", "kind", "canonical"]
    counted = candidates.groupingSets([whole, [*whole, "hardware"]], *whole, "hardware").agg(
        F.grouping("hardware").alias("_whole"),
        F.count_distinct("source_key").alias("occurrences"),
        F.max("ts").alias("newest"),
    )
    counted = counted.withColumn("hardware", F.when(F.col("_whole") == 0, F.col("hardware"))).drop("_whole")
    return snippets.with_meta(counted, F.when(F.col("hardware").isNull(), F.col("canonical")))


def aged(tallied: DataFrame, now: Column) -> DataFrame:
    """A tally with the best recency of each candidate, which is that of its newest report."""
    return tallied.withColumn("recency", scores.recency(F.col("newest"), now))


def mined(reports: DataFrame, now: Column, machines: DataFrame | None = None) -> DataFrame:
    """Tallied candidates with metadata, stored for all that is made of them; of asked-for apps only, if ``machines`` says which."""
    if machines is not None:
        reports = reports.join(machines.select("appid").distinct(), "appid", "left_semi")
    return aged(stored(tally(mine(reports))), now)


def score_candidates(tallied: DataFrame, machines: DataFrame) -> DataFrame:
    """Tallied candidates per app and asking machine, with the best similarity among their reporters."""
    kinds = tallied.where(F.col("hardware").isNotNull()).select("appid", "hardware", "kind", "canonical")
    pairs = alike(kinds.select("appid", "hardware").distinct(), machines)
    keys = ["appid", "kind", "canonical"]
    best = kinds.join(pairs, ["appid", "hardware"]).groupBy("machine", *keys)
    whole = tallied.where(F.col("hardware").isNull()).select(*keys, "occurrences", "recency")
    return (
        best.agg(F.max("similarity").alias("similarity"))
        .join(whole, keys)
        .withColumns(
            {
                "confidence": scores.suggestion_confidence(F.col("occurrences"), F.col("similarity"), F.col("recency")),
                "id": snippets.suggestion_id(F.col("kind"), F.col("canonical")),
            }
        )
    )


# --- merging ------------------------------------------------------------------------------------


def merge_key() -> Column:
    """Candidates with one label are one suggestion; those without stand for themselves."""
    return F.when(F.col("label") == "", F.col("canonical")).otherwise(F.col("label"))


def worth_showing() -> Column:
    return (F.col("label") != "") | (F.col("kind") == "launch_option")


_SHORT = "len int, cmd boolean, text string"
_BLOCK = f"appid int, key string, start struct<kind: string, canonical: string>, entries array<struct<{_SHORT}, last: struct<{_SHORT}>>>"


def _yields(held: tuple, new: tuple) -> bool:
    """Is a held snippet given up for a new one? For one without a command marker, or a shorter one."""
    return (held[1] and not new[1]) or new[0] < held[0]


def _fold_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a run of sorted snippets makes of any snippet held before it.

    Only the shortest so far and the first without a marker can take over from outside; for each
    of these the snippet held at the end of the run is kept.
    """
    run, start, entries, shortest, bare = None, None, [], None, False
    for batch in batches:
        out = []
        for appid, key, kind, text in zip(batch["appid"], batch["key"], batch["kind"], batch["canonical"]):
            if run != (appid, key):
                if run:
                    out.append((*run, start, entries))
                run, start, entries, shortest, bare = (appid, key), (kind, text), [], None, False
            new = (len(text), COMMAND in text, text)
            for entry in entries:
                if _yields(entry[3], new):
                    entry[3] = new
            if shortest is None or new[0] < shortest or (not new[1] and not bare):
                entries.append([*new, new])
            shortest, bare = min(shortest or new[0], new[0]), bare or not new[1]
        yield _blocks(out)
    if run:
        yield _blocks([(*run, start, entries)])


def _blocks(rows: list) -> pd.DataFrame:
    def entry(e):
        last = {"len": e[3][0], "cmd": e[3][1], "text": e[3][2]}
        return {"len": e[0], "cmd": e[1], "text": e[2], "last": last}

    return pd.DataFrame(
        [
            (int(appid), key, {"kind": start[0], "canonical": start[1]}, [entry(e) for e in entries])
            for appid, key, start, entries in rows
        ],
        columns=["appid", "key", "start", "entries"],
    )


def _fold_exactly(members: DataFrame) -> DataFrame:
    """Folded snippet of groups in which order decides: sorted runs first, then the runs together."""
    runs = (
        members.repartitionByRange("appid", "key", "kind", "canonical")
        .sortWithinPartitions("appid", "key", "kind", "canonical")
        .mapInPandas(_fold_runs, _BLOCK)
    )
    ordered = F.array_sort(F.collect_list(F.struct("start", "entries")))
    start = F.struct(
        F.lit(2147483647).alias("len"), F.lit(False).alias("cmd"), F.lit(None).cast("string").alias("text")
    )

    def step(held: Column, block: Column) -> Column:
        takes = lambda e: (held["cmd"] & ~e["cmd"]) | (e["len"] < held["len"])
        return F.coalesce(F.get(F.filter(block["entries"], takes), F.lit(0))["last"], held)

    folded = F.aggregate(ordered, start.cast(f"struct<{_SHORT}>"), step)
    return runs.groupBy("appid", "key").agg(folded["text"].alias("snippet"))


def fold_snippets(totals: DataFrame) -> DataFrame:
    """The snippet that stands for each merged suggestion, per app and key.

    Snippets are taken in order of kind and text; one gives way to the next if only the next has no
    command marker, or if the next is shorter. That is the first of the shortest ones unless only
    marked snippets are shortest among mixed ones; only those groups are folded step by step.
    """
    length, marked = F.length("canonical"), F.col("canonical").contains(COMMAND)
    place = F.struct(length.alias("len"), F.col("kind").alias("kind"), F.col("canonical").alias("canonical"))
    shortest = totals.groupBy("appid", "key").agg(
        F.min(place).alias("any"),
        F.min(F.when(~marked, place)).alias("bare"),
        F.count_if(marked).alias("marked"),
        F.count(F.lit(1)).alias("members"),
    )
    mixed = (F.col("marked") > 0) & (F.col("marked") < F.col("members"))
    open_ = mixed & (F.col("bare.len") > F.col("any.len"))
    settled = shortest.where(~open_).select(
        "appid", "key", F.when(mixed, F.col("bare.canonical")).otherwise(F.col("any.canonical")).alias("snippet")
    )
    ordered = totals.join(shortest.where(open_).select("appid", "key"), ["appid", "key"], "left_semi")
    return settled.unionByName(_fold_exactly(ordered.select("appid", "key", "kind", "canonical")))


def merge(scored: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates of one key as one suggestion: occurrences added, best scores, first member's identity."""
    labelled = scored.join(
        totals.select("appid", "kind", "canonical", "label", "description", "category", "key"),
        ["appid", "kind", "canonical"],
    )
    first = F.struct("id", "kind", "label", "description", "category", "confidence")
    merged = labelled.groupBy("machine", "appid", "key").agg(
        F.min_by(first, F.struct("kind", "canonical")).alias("first"),
        F.count(F.lit(1)).alias("members"),
        F.sum("occurrences").alias("occurrences"),
        F.max("similarity").alias("similarity"),
        F.max("recency").alias("recency"),
    )
    several, total, own = F.col("members") > 1, F.col("occurrences"), F.col("first.confidence")
    confidence = (
        F.when(several & (total >= 7), F.lit("high"))
        .when(several & (total >= 3) & (own == "low"), F.lit("medium"))
        .otherwise(own)
    )
    return merged.join(fold_snippets(totals), ["appid", "key"]).select(
        "machine",
        "appid",
        F.col("first.id").alias("id"),
        F.col("first.kind").alias("kind"),
        "snippet",
        F.col("first.label").alias("label"),
        F.col("first.description").alias("description"),
        F.col("first.category").alias("category"),
        "occurrences",
        "similarity",
        "recency",
        confidence.alias("confidence"),
    )


def labelled_totals(tallied: DataFrame) -> DataFrame:
    """Counts of the candidates worth showing, with their metadata and merge key."""
    totals = tallied.where(F.col("hardware").isNull()).drop("hardware")
    return totals.where(worth_showing()).withColumn("key", merge_key())


def suggestions(reports: DataFrame, machines: DataFrame, now: Column) -> DataFrame:
    """Merged suggestions of every app and asking machine. ``reports`` carry the hardware categories."""
    return suggestions_of(mined(reports, now, machines), machines)


def suggestions_of(tallied: DataFrame, machines: DataFrame) -> DataFrame:
    """Merged suggestions from a tally, such as one that a store keeps (``aged``); nothing is mined."""
    return merge(score_candidates(tallied, machines), labelled_totals(tallied))


def suggestion_order() -> list[Column]:
    return [
        scores.confidence_order(F.col("confidence")).desc(),
        F.col("occurrences").desc(),
        F.col("recency").desc(),
        F.col("similarity").desc(),
        F.col("id").asc(),
    ]


def rank_suggestions(merged: DataFrame) -> DataFrame:
    return number_rows(merged, ["appid", "machine"], suggestion_order())


def best_suggestions(merged: DataFrame, limit: int) -> DataFrame:
    return top_rows(merged, ["appid", "machine"], suggestion_order(), limit)


def shown_suggestions(merged: DataFrame, limit: int = SHOWN) -> DataFrame:
    """The first suggestions that are more than a symptom or a remark."""
    listed = merged.where(~F.col("kind").isin("diagnostic", "note") & worth_showing())
    return best_suggestions(listed, limit)


def suggestion_table(tallied: DataFrame) -> DataFrame:
    """What an aged tally says of snippets per app: counts and newest time.

    Without a machine to compare with, confidence is that of the neutral similarity.
    """
    return tallied.where(F.col("hardware").isNull()).select(
        "appid",
        F.col("canonical").alias("snippet"),
        "kind",
        "occurrences",
        F.col("newest").alias("newest_report_ts"),
        scores.suggestion_confidence(F.col("occurrences"), F.lit(0.5), F.col("recency")).alias("confidence"),
    )


def suggestion_sources(candidates: DataFrame) -> DataFrame:
    """Source reports of each mined snippet, one row each; grows with the reports, so it stays unnested."""
    return candidates.select(
        "appid", F.col("canonical").alias("snippet"), "kind", F.col("source_key").alias("source_report_id")
    ).distinct()


def app_digests(reports: DataFrame) -> DataFrame:
    """For each app a digest of everything that mining its reports looks at, whatever their order."""
    known = [name for name in NORM_COLUMNS if name in reports.columns]
    row = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("source_id", "source_report_id", "ts", "notes", "launch_options", *known)]
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\1", *row), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    other = F.conv(F.substring(F.sha2(F.concat_ws("\1", *row), 256), 16, 15), 16, 10).cast("decimal(20,0)")
    return reports.groupBy("appid").agg(
        F.count(F.lit(1)).alias("reports"), F.sum(digest).alias("digest"), F.sum(other).alias("other_digest")
    )


def changed_apps(new: DataFrame, old: DataFrame) -> DataFrame:
    """Apps ``(appid)`` whose reports differ between two tables of digests; those without any now are left out."""
    return new.join(old, new.columns, "left_anti").select("appid")
