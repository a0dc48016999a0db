"""Secrets in texts: three known shapes, and unknown ones by sliding-window entropy. Built-in functions only.

Known shapes (an assignment to a password-like name, an access key id, a long hexadecimal run) are found leftmost
and without overlap. Unknown ones are candidate strings: runs of 20 or more characters of base64. Each is of a
character class (hexadecimal, letters and digits, or base64), and a window of that class's width slides over it.
Counts per symbol, and with them the sum of ``c * log2(c)``, change only by the symbol that enters and the one that
leaves, so that every window's Shannon entropy is known in one pass. The candidate is a secret if some window
exceeds the class's limit, unless a rule of the allow list fits it or a known span overlaps it. With ``cut``, known
spans and the allowed fragments (sample words, rulers, repeats) only end a candidate: what lies outside of them is
judged by itself, so that a secret joined to one of these is found too.

Positions count code points, ends are exclusive. They come from the lengths of the matches and of the gaps between
them, summed in blocks, so that a text with very many matches takes no quadratic time. A null or empty text has
no span. Repeated rows are judged alike; extra columns are ignored by ``scan`` and kept by ``redacted``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import bind
from .common import free_name, text_or_empty

#: Known shapes in the order of their names in the output: pattern, group whose length counts, least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KNOWN = (
    ("assign", ASSIGN, 1, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)
#: A quicker pattern that every match which counts contains.
HINTS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": "AKIA[A-Z0-9]{16}",
    "hex": "[0-9a-f]{24}",
}

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


@dataclass(frozen=True)
class CharacterClass:
    name: str
    pattern: str
    window: int
    limit: float


#: From the narrowest to the widest; a candidate is of the first class that it fits.
CLASSES = (
    CharacterClass("entropy_hex", "^[0-9a-fA-F]+$", 20, 3.0),
    CharacterClass("entropy_alnum", "^[A-Za-z0-9]+$", 20, 3.6),
    CharacterClass("entropy_base64", "^.+$", 20, 3.8),
)

#: Strings that look random but are none: one-case words and paths, digits alone, UUIDs, rulers, sample values.
ALLOWED = (
    r"^[A-Z]?[a-z]+([/_=+-]+[A-Z]?[a-z]+)*[/_=+-]*$",
    r"^[A-Z]+([/_=+-]+[A-Z]+)*[/_=+-]*$",
    r"^[0-9/_=+-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|your[_-]?(api|secret|token|key)",
    r"(?i)abcdefghij|0123456789|123456789",
    r"(.)\1{7}",
)

#: The rules of the allow list that fit a part of a candidate, by the length of the match, longest first; the others
#: fit a candidate as a whole.
FRAGMENTS = (
    (11, "(?i)placeholder|your[_-]secret"),
    (10, "(?i)abcdefghij|0123456789|your[_-]token|yoursecret"),
    (9, "(?i)123456789|yourtoken"),
    (8, "(?i)changeme|redacted|your[_-](?:api|key)"),
    (7, "(?i)example|your(?:api|key)"),
    (6, "(?i)sample"),
    (5, "(?i)dummy"),
    (8, r"([A-Za-z0-9+/_=-])\1{7}"),
)
WHOLE = tuple(rule for rule in ALLOWED if rule.startswith("^"))

KINDS = tuple(kind for kind, *_ in KNOWN) + tuple(c.name for c in CLASSES)
#: Matches whose starts are summed one after the other.
BLOCK = 256


# --- positions ----------------------------------------------------------------------------------


def _running(values: Column) -> Column:
    """Sums of the values before each place, block by block."""
    none = F.array(F.lit(0).cast("long"))
    grown = lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / BLOCK).cast("int")),
        lambda b: F.slice(values, b * BLOCK + 1, BLOCK),
    )
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    heads = lambda all_: F.aggregate(F.transform(all_, total), none, grown)
    sums_within = lambda x, head: F.slice(F.aggregate(x, F.array(head), grown), 1, F.size(x))
    return bind(blocks, lambda all_: F.flatten(F.zip_with(all_, F.slice(heads(all_), 1, F.size(all_)), sums_within)))


def _spans(text: Column, pattern: str, hint: str, kind: int, wanted: Callable[[Column], Column]) -> Column:
    """Structs (start, kind, end, found) of the wanted matches; the gaps between all matches give their places."""
    shape = "array<struct<start:bigint,kind:int,end:bigint,found:string>>"

    def placed(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]
        moves = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, m: gap + F.length(m))
        spans = F.zip_with(
            bind(moves, lambda m: F.zip_with(_running(m), m, lambda before, move: before + move)),
            found,
            lambda end, m: F.struct(
                (end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("found")
            ),
        )
        return F.filter(spans, lambda s: wanted(s["found"]))

    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long")).alias("gaps"),
    )
    return F.when(F.rlike(text, F.lit(hint)), bind(both, placed)).otherwise(F.array()).cast(shape)


# --- entropy ------------------------------------------------------------------------------------


def _weight(n: int) -> float:
    return n * math.log2(n) if n else 0.0


def highest_entropy(candidate: Column, window: int) -> Column:
    """Largest Shannon entropy of any window; 0 if the string is shorter."""
    numbers = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    weights = F.array(*[F.lit(_weight(n)) for n in range(window + 2)])
    zero = F.array_repeat(F.lit(0), len(SYMBOLS) + 1)
    start = F.struct(zero.alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(1).alias("at"))

    def weighed(count: Column) -> Column:
        return F.element_at(weights, count + 1)

    def step(symbols: Column, state: Column, entering: Column) -> Column:
        full = state["at"] > window
        leaving = F.when(full, F.element_at(symbols, F.greatest(state["at"] - window, F.lit(1)))).otherwise(F.lit(-1))
        counts, same = state["counts"], leaving == entering
        into, out = F.element_at(counts, entering + 1), F.element_at(counts, F.greatest(leaving, F.lit(0)) + 1)
        total = F.when(same, state["sum"]).otherwise(
            state["sum"]
            + weighed(into + 1)
            - weighed(into)
            + F.when(full, weighed(F.greatest(out - 1, F.lit(0))) - weighed(out)).otherwise(F.lit(0.0))
        )
        moved = F.when(same, counts).otherwise(
            F.transform(counts, lambda v, j: v + (j == entering).cast("int") - (j == leaving).cast("int"))
        )
        entropy = F.lit(math.log2(window)) - total / window
        best = F.when(state["at"] >= window, F.greatest(state["best"], entropy)).otherwise(state["best"])
        return F.struct(moved.alias("counts"), total.alias("sum"), best.alias("best"), (state["at"] + 1).alias("at"))

    def highest(symbols: Column) -> Column:
        return F.aggregate(symbols, start, lambda state, entering: step(symbols, state, entering), lambda state: state["best"])

    return bind(numbers, highest)


def _class_of(candidate: Column) -> Column:
    chosen = F
    for number, entry in enumerate(CLASSES):
        chosen = chosen.when(candidate.rlike(entry.pattern), F.lit(len(KNOWN) + number))
    return chosen


def _allowed(candidate: Column, rules: tuple[str, ...] = ALLOWED) -> Column:
    fits = F.lit(False)
    for pattern in rules:
        fits = fits | candidate.rlike(pattern)
    return fits


def _secret(candidate: Column) -> Column:
    chosen = F
    for entry in CLASSES:
        over = highest_entropy(candidate, entry.window) > entry.limit
        chosen = chosen.when(candidate.rlike(entry.pattern), over)
    return chosen.otherwise(F.lit(False))


# --- the operator -------------------------------------------------------------------------------


def _overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def _long_enough(pattern: str, group: int, least: int) -> Callable[[Column], Column]:
    if group:
        return lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least
    return lambda m: F.length(m) >= least


def _replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """The text with ``by(length)`` in place of each span; ``length`` is that of the part outside earlier spans."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, span: Column) -> Column:
        begin = F.greatest(span["start"], state["at"])
        gap = F.substring(text, (state["at"] + 1).cast("int"), (begin - state["at"]).cast("int"))
        own = by(F.greatest(span["end"] - begin, F.lit(0)).cast("int"))
        return F.struct(
            F.concat(state["done"], F.array(F.concat(gap, own))).alias("done"),
            F.greatest(state["at"], span["end"]).alias("at"),
        )

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["done"], ""), F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    return F.aggregate(spans, start, step, finish)


def with_spans(
    docs: DataFrame, text: str = "text", names: tuple[str, str] = ("base", "spans"), cut: bool = False
) -> DataFrame:
    """Adds the known spans and all spans: arrays of (start, kind, end, found) by start and kind (a number of ``KINDS``)."""
    base, spans = names
    whole = text_or_empty(text)
    found = [
        _spans(whole, pattern, HINTS[kind], number, _long_enough(pattern, group, least))
        for number, (kind, pattern, group, least) in enumerate(KNOWN)
    ]
    if cut:
        known = F.array_sort(F.concat(*found))
        outside = F.when(F.size(known) > 0, bind(known, lambda all_: _replaced(whole, all_, lambda n: F.repeat(F.lit(" "), n)))).otherwise(whole)
        for length, fragment in FRAGMENTS:
            outside = F.regexp_replace(outside, fragment, " " * length)
        outside = F.when(F.rlike(whole, F.lit(CANDIDATE)), outside).otherwise(F.lit(""))
        candidates = bind(outside, lambda t: _spans(t, CANDIDATE, CANDIDATE, len(KNOWN), lambda c: ~_allowed(c, WHOLE)))
    else:
        candidates = _spans(whole, CANDIDATE, CANDIDATE, len(KNOWN), lambda c: ~_allowed(c))
    raw = docs.withColumn(base, F.array_sort(F.concat(*found))).withColumn(spans, candidates)
    free = F.filter(spans, lambda s: ~_overlaps(s, F.col(base)) & _secret(s["found"]))
    classed = F.transform(
        free,
        lambda s: F.struct(
            s["start"].alias("start"), _class_of(s["found"]).alias("kind"), s["end"].alias("end"), s["found"].alias("found")
        ),
    )
    return raw.withColumn(spans, F.array_sort(F.concat(F.col(base), classed)))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(kind) for kind in KINDS])
    line = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(line, ",")


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, base, spans of each row."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return with_spans(rows).select("doc_id", "base", "spans")


def redacted(docs: DataFrame, text: str = "text", by: str = "[SECRET]", cut: bool = False) -> DataFrame:
    """All documents and columns, each span of the text replaced; spans that overlap become one replacement."""
    base, spans = free_name(docs, "_base", "_spans")
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    whole = text_or_empty(text)

    def step(state: Column, span: Column) -> Column:
        apart = span["start"] >= state["at"]
        gap = F.substring(whole, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        done = F.when(apart, F.concat(state["done"], gap, F.lit(by))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.greatest(state["at"], span["end"]).alias("at"))

    def finish(state: Column) -> Column:
        return F.concat(state["done"], F.substring(whole, (state["at"] + 1).cast("int"), F.length(whole)))

    clean = F.aggregate(F.col(spans), start, step, finish)
    found = with_spans(docs, text, (base, spans), cut)
    return found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(text))).select(docs.columns)


def count_of(spans: Column, kind: int) -> Column:
    """Number of spans of a kind; the lambda takes one argument only, a second one would be the place in the array."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every whole text of documents."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [count_of(F.col("base"), number).alias(f"n_{kind}") for number, (kind, *_) in enumerate(KNOWN)]
    digest = F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, written(F.col("spans")).alias("spans"))
