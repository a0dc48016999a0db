"""Age, recency, similarity, quality and display labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..schemas import COMPARED_FIELDS
from .text import pattern, present, sentence_list, strip, text_or_empty

# Day limits, weights and rating bases.
FRESH_DAYS, RECENT_DAYS, HISTORICAL_DAYS = 90, 365, 730
RECENCY_WEIGHT, SIMILARITY_WEIGHT, QUALITY_WEIGHT = 0.72, 0.20, 0.08
RATING_BASE = (("platinum", 0.95), ("gold", 0.85), ("silver", 0.65), ("bronze", 0.45), ("borked", 0.20))
TWEAK_ENV = r"\b[A-Z_][A-Z0-9_]{2,}="
TWEAK_WRAPPER = r"\b(gamemoderun|mangohud|gamescope|prime-run|obs-gamecapture)\b"
NOTHING_COMPARED = "No comparable system fields were available."
BADGES = ((95, "Excellent"), (85, "Good"), (70, "Playable"), (50, "Issues"))
FEW_REPORTS = 5


def round3(value: Column) -> Column:
    """Three decimals, halves away from zero."""
    return F.round(value * 1000.0, 0) / 1000.0


def _age(ts: Column, now: Column) -> Column:
    return (F.unix_millis(now) - F.unix_millis(ts)) / F.lit(86400000.0)


def age_days(ts: Column, now: Column) -> Column:
    """Whole days of age, never negative; 0 without a time."""
    return F.coalesce(F.greatest(F.lit(0), _age(ts, now).cast("int")), F.lit(0))


def recency(ts: Column, now: Column) -> Column:
    """Piecewise linear score of age; 0 without a time."""
    age = _age(ts, now)
    span = lambda start, end: (age - float(start)) / float(end - start)
    return (
        F.when(ts.isNull(), F.lit(0.0))
        .when(age <= 30.0, F.lit(1.0))
        .when(age <= FRESH_DAYS, round3(F.lit(0.95) - span(30, FRESH_DAYS) * 0.10))
        .when(age < RECENT_DAYS, round3(F.lit(0.75) - span(FRESH_DAYS, RECENT_DAYS) * 0.35))
        .when(age < HISTORICAL_DAYS, round3(F.lit(0.24) - span(RECENT_DAYS, HISTORICAL_DAYS) * 0.12))
        .otherwise(F.lit(0.05))
    )


def freshness(ts: Column, now: Column) -> Column:
    age = age_days(ts, now)
    return (
        F.when(age < FRESH_DAYS, F.lit("fresh"))
        .when(age < RECENT_DAYS, F.lit("recent"))
        .when(age < HISTORICAL_DAYS, F.lit("stale"))
        .otherwise(F.lit("historical"))
    )


def comparable(value: Column) -> Column:
    """Stripped lower case; NULL where blank or unknown."""
    return F.nullif(F.lower(present(value)), F.lit("unknown"))


def field_match(user: Column, report: Column, partial: bool) -> Column:
    """1 for equal, 0.7 for containment where that is allowed, else 0."""
    score = F.when(user == report, F.lit(1.0))
    if partial:
        long_enough = (F.length(user) >= 4) & (F.length(report) >= 4)
        score = score.when(long_enough & (user.contains(report) | report.contains(user)), F.lit(0.7))
    return score.otherwise(F.lit(0.0))


def _sides(user: dict[str, Column], report: dict[str, Column]):
    for column, name, weight, partial in COMPARED_FIELDS:
        yield name, weight, partial, user[column], report[column]


def similarity(user: dict[str, Column], report: dict[str, Column]) -> Column:
    """Weighted share of matching fields among those known on both sides; 0.5 when none is.

    Both sides are ``comparable`` values, made once per machine rather than per pair.
    """
    matched, known = [], []
    for _, weight, partial, mine, theirs in _sides(user, report):
        both = mine.isNotNull() & theirs.isNotNull()
        matched.append(F.when(both, F.lit(weight) * field_match(mine, theirs, partial)).otherwise(F.lit(0.0)))
        known.append(F.when(both, F.lit(weight)).otherwise(F.lit(0.0)))
    add = lambda left, right: left + right
    total = reduce(add, known)
    return F.when(total == 0.0, F.lit(0.5)).otherwise(round3(reduce(add, matched) / F.nullif(total, F.lit(0.0))))


def similarity_details(user: dict[str, Column], report: dict[str, Column]) -> dict[str, Column]:
    """Lists of matches, mismatches and unknown fields."""
    matches, mismatches, unknowns = [], [], []
    for name, _, partial, mine, theirs in _sides(user, report):
        both = mine.isNotNull() & theirs.isNotNull()
        hit = field_match(mine, theirs, partial) > 0
        low = name.lower()
        matches.append(F.when(both & hit, F.concat(F.lit(low + " "), theirs)))
        mismatches.append(
            F.when(both & ~hit, F.concat(F.lit(low + " user="), mine, F.lit(" report="), theirs))
        )
        unknowns.append(
            F.when(mine.isNull() & theirs.isNull(), F.lit(name + " unknown for user and report"))
            .when(mine.isNull(), F.lit(name + " unknown for user"))
            .when(theirs.isNull(), F.lit(name + " unknown for report"))
        )
    return {
        "matches": F.array_compact(F.array(*matches)),
        "mismatches": F.array_compact(F.array(*mismatches)),
        "unknowns": F.array_compact(F.array(*unknowns)),
    }


def similarity_summary(matches: Column, mismatches: Column, unknowns: Column) -> Column:
    """One sentence on what matched, differed and was not known."""

    def part(prefix: str, values: Column, limit: int) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(prefix), sentence_list(values, limit)))

    parts = F.concat_ws(
        "; ", part("matches ", matches, 3), part("differs on ", mismatches, 3), part("unknown ", unknowns, 2)
    )
    compared = (F.size(matches) + F.size(mismatches)) > 0
    return F.when(compared, F.concat(parts, F.lit("."))).otherwise(F.lit(NOTHING_COMPARED))


def quality(rating: Column, launch_options: Column, notes: Column, verdict: Column) -> Column:
    """Rating base, plus a boost for a concrete tweak and one for a verdict."""
    key = F.lower(strip(text_or_empty(rating)))
    base: Column | None = None
    for name, value in RATING_BASE:
        base = F.when(key == name, F.lit(value)) if base is None else base.when(key == name, F.lit(value))
    base = base.otherwise(F.lit(0.45))
    text = text_or_empty(notes)
    tweak = (
        present(launch_options).isNotNull()
        | F.lower(text).contains("%command%")
        | text.rlike(pattern(TWEAK_ENV, ignore_case=False))
        | text.rlike(pattern(TWEAK_WRAPPER))
    )
    boosted = F.when(tweak, base + F.lit(0.08)).otherwise(base)
    scored = F.when(present(verdict).isNotNull(), boosted + F.lit(0.03)).otherwise(boosted)
    return round3(F.least(F.lit(1.0), F.greatest(F.lit(0.0), scored)))


def rank_score(recency_score: Column, similarity_score: Column, quality_score: Column) -> Column:
    return round3(
        recency_score * RECENCY_WEIGHT + similarity_score * SIMILARITY_WEIGHT + quality_score * QUALITY_WEIGHT
    )


def report_reasons(fresh: Column, age: Column, recency_score: Column, quality_score: Column, launch_options: Column) -> tuple[Column, Column]:
    """What a report gives of its reasons whoever asks: the first, and the list of those after likeness."""
    first = F.format_string("%s report (%d days old, recency %.3f", fresh, age, recency_score)
    later = F.array(
        F.format_string("quality %.3f from rating/verdict/concrete tweak signals", quality_score),
        F.when(present(launch_options).isNotNull(), F.lit("explicit launch options field present")),
        F.when(fresh.isin("stale", "historical"), F.lit("treat as historical context, not current truth")),
    )
    return first, F.array_compact(later)


def similarity_reason(similarity_score: Column, summary: Column) -> Column:
    return F.format_string("system similarity %.3f: %s", similarity_score, summary)


def reasons(first: Column, likeness: Column, later: Column) -> Column:
    """Why a report stands where it does."""
    return F.concat(F.array(first, likeness), later)


def suggestion_confidence(occurrences: Column, best_similarity: Column, best_recency: Column) -> Column:
    step = F.when(occurrences >= 7, F.lit(0.4)).when(occurrences >= 3, F.lit(0.25)).otherwise(F.lit(0.1))
    score = step + best_similarity * 0.3 + best_recency * 0.3
    return F.when(score >= 0.65, F.lit("high")).when(score >= 0.35, F.lit("medium")).otherwise(F.lit("low"))


def confidence_order(confidence: Column) -> Column:
    return F.when(confidence == "high", 3).when(confidence == "medium", 2).otherwise(1)


def confidence_label(confidence: Column) -> Column:
    return (
        F.when(confidence == "high", F.lit("Strongly recommended"))
        .when(confidence == "medium", F.lit("Recommended"))
        .otherwise(F.lit("Try if needed"))
    )


def similarity_label(score: Column) -> Column:
    return (
        F.when(score >= 0.5, F.lit("Similar hardware"))
        .when(score >= 0.2, F.lit("Somewhat similar"))
        .otherwise(F.lit("Different hardware"))
    )


def percent_yes(yes: Column, total: Column) -> Column:
    """Whole percent, 0 without reports."""
    share = F.try_divide(yes.cast("bigint") * 100, total)
    return F.coalesce(F.floor(share).cast("int"), F.lit(0))


def verdict_badge(total: Column, percent: Column) -> Column:
    badge = F.when(total < FEW_REPORTS, F.lit("Few reports"))
    for floor, name in BADGES:
        badge = badge.when(percent >= floor, F.lit(name))
    return badge.otherwise(F.lit("Borked"))


def rating_tooltip(total: Column, window: Column, percent: Column) -> Column:
    return F.format_string("%d reports (%s): %d%% recommended", total, window, percent)


def runtime_tooltip(count: Column, total: Column, window: Column) -> Column:
    return F.format_string("Based on %d of %d %s reports", count, total, window)
