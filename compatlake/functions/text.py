"""Whitespace, case and string-list expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Characters that count as blank at the ends of a text.
BLANKS = " \t\n\x0b\f\r\x85                 　"
_BLANK_RUN = "[" + BLANKS + "]+"
#: An ASCII word boundary, the same on every Java version.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def strip(value: Column) -> Column:
    """Without blanks at either end."""
    return F.btrim(value, F.lit(BLANKS))


def simplify(value: Column) -> Column:
    """Runs of blanks become one space, ends are trimmed."""
    return strip(F.regexp_replace(value, _BLANK_RUN, " "))


def present(value: Column) -> Column:
    """The stripped text, or NULL where nothing is left."""
    return F.nullif(strip(value), F.lit(""))


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def first_nonblank(*values: Column) -> Column:
    """First of several texts that is not blank, stripped; NULL when all are."""
    return F.coalesce(*[present(value) for value in values])


def pattern(regexp: str, ignore_case: bool = True) -> str:
    """A regexp whose word boundaries are ASCII, as a Java pattern.

    A boundary at the start stands before a word character in all patterns used here, so that a
    look behind is enough.
    """
    if regexp.startswith(r"\b"):
        regexp = "(?<![A-Za-z0-9_])" + regexp[2:]
    return ("(?i)" if ignore_case else "") + regexp.replace(r"\b", _EDGE)


def words(value: Column, separator: str = " ") -> Column:
    """Non-empty pieces between literal separators."""
    return F.filter(F.split(value, separator), lambda piece: piece != F.lit(""))


def contains_any(value: Column, needles: tuple[str, ...]) -> Column:
    found = value.contains(needles[0])
    for needle in needles[1:]:
        found = found | value.contains(needle)
    return found


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used; keeps generated code small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def classify(value: Column, classes: tuple[tuple[str, tuple[str, ...]], ...], default: str) -> Column:
    """First class any of whose needles the text holds."""

    def label(text: Column) -> Column:
        found: Column | None = None
        for name, needles in classes:
            test = contains_any(text, needles)
            found = F.when(test, F.lit(name)) if found is None else found.when(test, F.lit(name))
        return found.otherwise(F.lit(default))

    return bind(value, label)


def dedupe_ignoring_case(values: Column) -> Column:
    """Stripped non-blank texts, the first spelling of each kept in order."""

    def first_spellings(clean: Column, low: Column) -> Column:
        distinct = F.filter(clean, lambda text, at: F.array_position(low, F.get(low, at)) == at + F.lit(1))
        return F.when(F.size(clean) < 2, clean).otherwise(distinct)

    clean = F.filter(F.transform(values, strip), lambda text: text != F.lit(""))
    return bind(clean, lambda c: bind(F.transform(c, F.lower), lambda low: first_spellings(c, low)))


def sentence_list(values: Column, limit: int) -> Column:
    """Up to ``limit`` texts joined by commas, then how many more there are."""
    more = F.concat((F.size(values) - F.lit(limit)).cast("string"), F.lit(" more"))
    shown = F.when(F.size(values) > limit, F.concat(F.slice(values, 1, limit), F.array(more))).otherwise(values)
    return F.array_join(shown, ", ")


def upper_first(value: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, 2, 2147483647))
