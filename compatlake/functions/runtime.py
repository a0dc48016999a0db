"""Runtime labels of reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import present, strip, text_or_empty, upper_first, words

# Texts that name no runtime, and display forms of the known ones.
NO_RUNTIME = ("", "none", "n/a", "unknown", "default")
DISPLAY_FORMS = (
    ("Native", ("native",)),
    ("Official Proton", ("official", "official proton")),
    ("Proton Experimental", ("experimental", "proton experimental")),
    ("Proton-GE", ("ge", "proton ge", "proton-ge")),
    ("Proton-CachyOS", ("proton-cachyos",)),
)


def report_runtime(document: Column, column_value: Column) -> Column:
    """Runtime of a report: the note's variant, the stored column, then the response's own fields.

    ``document`` is the parsed JSON, a column made beforehand. JSON that cannot be read leaves the
    stored value as it is.
    """

    def text_at(path: str) -> Column:
        value = F.try_variant_get(document, path, "variant")
        return F.when(F.schema_of_variant(value) == "STRING", present(F.try_variant_get(document, path, "string")))

    readable = F.schema_of_variant(document).startswith("OBJECT")
    chosen = F.coalesce(
        text_at("$.responses.notes.variant"),
        present(column_value),
        text_at("$.responses.protonVersion"),
        text_at("$.responses.variant"),
        F.lit(""),
    )
    return F.when(readable, chosen).otherwise(text_or_empty(column_value))


def runtime_key(value: Column) -> Column:
    """Comparison form of a runtime."""
    return strip(F.lower(text_or_empty(value)))


def names_runtime(key: Column) -> Column:
    """Does a comparison form name a runtime at all?"""
    return ~key.isin(*NO_RUNTIME)


def runtime_label(value: Column) -> Column:
    """Display form: the five known ones, else each word's first letter in upper case."""
    key = runtime_key(value)
    label: Column | None = None
    for form, keys in DISPLAY_FORMS:
        test = key.isin(*keys)
        label = F.when(test, F.lit(form)) if label is None else label.when(test, F.lit(form))
    spelled = F.array_join(F.transform(words(strip(value)), upper_first), " ")
    return label.when(key == "", value).otherwise(spelled)
