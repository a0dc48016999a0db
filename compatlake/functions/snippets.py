"""Snippet expressions: canonical form, metadata, safety, and candidates in a report's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import rules
from .text import contains_any, pattern, simplify, strip, text_or_empty, words

_COMMAND_LENGTH = len(rules.COMMAND)


def canonical(snippet: Column) -> Column:
    return F.lower(simplify(snippet))


# --- launch lines ------------------------------------------------------------------------------


def _command_at(text: Column) -> Column:
    return F.instr(F.lower(text), rules.COMMAND)


def has_command(text: Column) -> Column:
    return _command_at(text) > 0


def before_command(text: Column) -> Column:
    """Stripped part before the first command marker."""
    return strip(F.substring(text, F.lit(1), _command_at(text) - 1))


def after_command(text: Column) -> Column:
    """Stripped part after the first command marker."""
    return strip(F.substring(text, _command_at(text) + _COMMAND_LENGTH, F.length(text)))


def is_env_assignment(token: Column) -> Column:
    """A known variable name, or one with a known prefix, before the first equals sign."""
    name = F.upper(F.substring_index(token, "=", 1))
    known = name.isin(*rules.ENV_NAMES)
    for prefix in rules.ENV_PREFIXES:
        known = known | name.startswith(prefix)
    return (F.instr(token, "=") > 1) & known


def split_env(token: Column) -> Column:
    """``(name, value)`` of an assignment; NULL unless both sides are there."""
    at = F.instr(token, "=")
    name = F.upper(strip(F.substring_index(token, "=", 1)))
    value = strip(F.substring(token, at + 1, F.length(token)))
    return F.when(
        (at > 1) & (at < F.length(token)) & (name != ""), F.struct(name.alias("name"), value.alias("value"))
    )


def trim_outer_quotes(text: Column) -> Column:
    """Stripped, and without one pair of like quotes around it."""
    bare = strip(text)
    quoted = (F.length(bare) >= 2) & (
        (bare.startswith('"') & bare.endswith('"')) | (bare.startswith("'") & bare.endswith("'"))
    )
    return F.when(quoted, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)


def is_dangerous(snippet: Column) -> Column:
    """Control characters, commands that change the system, or shell operators."""
    low = F.lower(strip(snippet))
    bad = snippet.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    for word in rules.DANGEROUS_WORDS:
        bad = bad | low.startswith(word) | low.contains(" " + word)
    return bad | contains_any(snippet, rules.SHELL_OPERATORS)


def is_wrapper(token: Column) -> Column:
    return F.lower(token).isin(*rules.WRAPPERS)


def is_copyable_kind(kind: Column) -> Column:
    return kind.isin(*rules.COPYABLE_KINDS)


def display_case(line: Column) -> Column:
    """Launch line for display: assignments in upper case, the rest in lower, the marker as it is."""

    def token(piece: Column) -> Column:
        return (
            F.when(piece == rules.COMMAND, piece).when(piece.contains("="), F.upper(piece)).otherwise(F.lower(piece))
        )

    return F.array_join(F.transform(words(line), token), " ")


# --- metadata ----------------------------------------------------------------------------------


def snippet_core(snippet: Column) -> Column:
    """Lower-case snippet without its command marker: the part before it, else the part after."""
    low = F.lower(strip(snippet))
    return F.when(has_command(low), F.coalesce(F.nullif(before_command(low), F.lit("")), after_command(low))).otherwise(
        low
    )


def env_label(core: Column) -> Column:
    """Label of an assignment without a rule: its name less known prefixes."""
    name = F.upper(F.substring_index(core, "=", 1))
    for prefix in rules.ENV_LABEL_PREFIXES:
        name = F.regexp_replace(name, "^" + prefix, "")
    return F.lower(strip(F.replace(name, F.lit("_"), F.lit(" "))))


def meta_rule(core: Column) -> Column:
    """Number of the first rule a snippet core matches; the core should be a column made beforehand."""
    number = F.when(core == "", F.lit(len(rules.KNOWN_SNIPPETS)))
    for at, (regexp, _, _, _) in enumerate(rules.KNOWN_SNIPPETS):
        # the core is in lower case, so that plain rules need no pattern
        found = core.rlike(pattern(regexp)) if "*" in regexp else core.contains(regexp)
        number = number.when(found, F.lit(at))
    return number.when(core.contains("="), F.lit(len(rules.KNOWN_SNIPPETS) + 1))


def meta_of_rule(number: Column, core: Column) -> dict[str, Column]:
    """Label, description and category of a rule number."""
    known = rules.KNOWN_SNIPPETS

    def pick(values: list[str]) -> Column:
        return F.coalesce(F.get(F.array(*[F.lit(v) for v in values]), number), F.lit(""))

    label = F.when(number == len(known) + 1, env_label(core)).otherwise(
        pick([label for _, label, _, _ in known] + ["Unknown option"])
    )
    return {
        "label": label,
        "description": pick([description for _, _, description, _ in known]),
        "category": pick([category for _, _, _, category in known]),
    }


def with_meta(df: DataFrame, snippet: Column) -> DataFrame:
    """Add label, description and category of a snippet."""
    ruled = df.withColumn("_core", snippet_core(snippet)).withColumn("_rule", meta_rule(F.col("_core")))
    return ruled.withColumns(meta_of_rule(F.col("_rule"), F.col("_core"))).drop("_core", "_rule")


def suggestion_id(kind: Column, snippet: Column) -> Column:
    digest = F.sha1(F.concat(kind, snippet))
    return F.concat(F.substring(kind, 1, 5), F.lit("-"), F.substring(digest, 1, 8))


# --- candidates in a report --------------------------------------------------------------------


def search_text(notes: Column, launch_options: Column) -> Column:
    return F.concat(text_or_empty(notes), F.lit(" "), text_or_empty(launch_options))


def _candidate(kind: str, snippet: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), snippet.alias("canonical"))


def option_candidates(launch_options: Column) -> Column:
    """The launch options field itself."""
    options = text_or_empty(launch_options)
    return F.filter(
        F.array(_candidate("launch_option", canonical(options))), lambda _: options != F.lit("")
    )


def phrase_candidates(text: Column, low: Column) -> Column:
    """First match of each phrase pattern; ``low`` is the text in lower case."""
    found = [
        F.when(
            contains_any(low, hints),
            _candidate(kind, canonical(F.regexp_extract(text, pattern(regexp), 0))),
        )
        for (kind, regexp), hints in zip(rules.PHRASES, rules.PHRASE_HINTS)
    ]
    return F.filter(F.array_compact(F.array(*found)), lambda c: c["canonical"] != F.lit(""))


def command_line(text: Column) -> Column:
    """The line with the first command marker, lower case; NULL if short or only a form answer."""
    line = F.get(F.filter(F.split(text, "\n"), has_command), F.lit(0))
    low = F.lower(strip(line))
    return F.when((F.length(low) > 5) & ~contains_any(low, rules.FORM_LINES), low)


def command_line_candidates(text: Column) -> Column:
    return F.filter(
        F.array(_candidate("launch_option", command_line(text))), lambda c: c["canonical"].isNotNull()
    )


def env_candidates(text: Column) -> Column:
    """Every environment assignment."""
    found = F.when(text.contains("="), F.regexp_extract_all(text, F.lit(pattern(rules.ENV_IN_TEXT)), F.lit(0)))
    found = F.coalesce(found, F.array().cast("array<string>"))
    return F.transform(found, lambda match: _candidate("env_var", canonical(match)))


def wrapper_candidates(low: Column) -> Column:
    """Every wrapper named anywhere in a lower-case text."""
    names = F.array(*[F.when(low.contains(name), F.lit(name)) for name in rules.WRAPPERS])
    return F.transform(F.array_compact(names), lambda name: _candidate("wrapper", name))


def candidates(text: Column, low: Column, launch_options: Column) -> Column:
    """All candidates of one report as one array, so that one explode yields them; NULL without text.

    ``text`` and its lower case ``low`` are used some thirty times: give them as columns made beforehand.
    """
    return F.when(
        strip(text) != "",
        F.array_distinct(
            F.concat(
                option_candidates(launch_options),
                phrase_candidates(text, low),
                command_line_candidates(text),
                env_candidates(text),
                wrapper_candidates(low),
            )
        ),
    )
