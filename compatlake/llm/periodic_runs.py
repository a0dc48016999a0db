"""Runs of periodically repeated words, by Kruskal's algorithm over common prefixes in descending order.

A run is a stretch of words with smallest period q, at least ``exponent`` times as long as q and at least ``least`` words long,
which no neighbouring word extends. Suffixes of a text are sorted by prefix doubling, their common prefixes follow
from the irreducible ones, and then suffixes are united in descending order of common prefix: a union-find whose
classes are ordered sets of word positions, the smaller always dealt into the larger. Two positions that become
neighbours at distance d with a common prefix of l >= d words are a seed: the words from the first one on have period d
for d + l words, and no shorter one, as a shorter period would have put a position between them before. The start of each run is a seed, so
runs are the seeds whose words before differ.

Only texts in which some window of words repeats that is as long as the least run demands are sorted at all; hashes of
windows tell, and a collision only costs time. Words are compared as bytes.

A text is handled by one task, in memory proportional to its words and time n log n. A null text has no words, no runs and an empty
kept text. Ids are passed on, nulls and ties too; repeated rows are judged alike, each by itself. An empty table gives an empty one. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from compatlake.functions.text import bind

from .common import BLANKS, map_batches, mixed, steps, window_hashes, word_bounds, word_hashes

EXPONENT = 4
LEAST = 6

SCHEMA = "doc long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string"


def sorted_suffixes(words: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling the compared prefix; positions alone in their class are left."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = words[order][1:] != words[order][:-1]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    width = 1
    shared = ~fresh
    shared[:-1] |= ~fresh[1:]
    open_ = order[shared]
    while len(open_):
        follower = open_ + width
        after = np.where(follower < n, rank[np.minimum(follower, n - 1)] + 1, 0)
        key = rank[open_] * (n + 2) + after
        sort = np.argsort(key, kind="stable")
        open_, key = open_[sort], key[sort]
        group = key // (n + 2)
        new_group, new_key = np.ones(len(key), dtype=bool), np.ones(len(key), dtype=bool)
        new_group[1:], new_key[1:] = group[1:] != group[:-1], key[1:] != key[:-1]
        at = np.arange(len(key))
        rank[open_] = group + np.maximum.accumulate(np.where(new_key, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        shared = ~new_key
        shared[:-1] |= ~new_key[1:]
        open_ = open_[shared]
        width *= 2
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes


def common_prefix(words: np.ndarray, one: int, two: int, start: int) -> int:
    """Words in common from two positions on, the first ``start`` known; compared in growing blocks."""
    block, most = 64, len(words) - max(one, two)
    while start < most:
        size = min(block, most - start)
        differ = words[one + start : one + start + size] != words[two + start : two + start + size]
        place = int(differ.argmax())
        if differ[place]:
            return start + place
        start += size
        block *= 2
    return most


def neighbour_prefixes(words: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order; 0 for the first.

    Where the words before two neighbours are equal too, the prefix is one less than that of the position before.
    Only the others are compared; their lengths sum up to n log n.
    """
    n = len(words)
    before = np.full(n, -1, dtype=np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    at = np.arange(n)
    plain = (at == 0) | (before <= 0) | (words[at - 1] != words[np.maximum(before - 1, 0)])
    prefix = np.zeros(n, dtype=np.int64)
    left = np.flatnonzero(plain & (before >= 0))
    for step in range(32):
        reach = np.maximum(left, before[left]) + step
        inside = reach < n
        left = left[inside]
        left = left[words[left + step] == words[before[left] + step]]
        prefix[left] = step + 1
        if not len(left):
            break
    for position in left.tolist():
        prefix[position] = common_prefix(words, position, int(before[position]), 32)
    origin = np.maximum.accumulate(np.where(plain, at, 0))
    whole = prefix[origin] - (at - origin)
    out = whole[suffixes]
    out[0] = 0
    return out


def seeds(suffixes: np.ndarray, prefixes: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(position, distance, common prefix) of positions that become neighbours, with a prefix of (exponent - 1) distances."""
    edges = np.flatnonzero(prefixes >= least)
    edges = edges[np.argsort(-prefixes[edges], kind="stable")]
    owner: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    found = []

    def find(place: int) -> int:
        root = place
        while owner.setdefault(root, root) != root:
            root = owner[root]
        while owner[place] != root:
            owner[place], place = root, owner[place]
        return root

    ones, twos, lengths = suffixes[edges - 1].tolist(), suffixes[edges].tolist(), prefixes[edges].tolist()
    for one, two, length in zip(ones, twos, lengths):
        one, two = find(one), find(two)
        large, small = members.pop(one, [one]), members.pop(two, [two])
        if len(large) < len(small):
            one, two, large, small = two, one, small, large
        owner[two] = one
        reach = length // (exponent - 1)
        low = 0
        for turn, position in enumerate(small):
            place = bisect_left(large, position, low)
            # Neighbours out of the small set itself are not new.
            if place and (turn == 0 or large[place - 1] != small[turn - 1]) and position - large[place - 1] <= reach:
                found.append((large[place - 1], position - large[place - 1], length))
            if place < len(large) and (turn + 1 == len(small) or small[turn + 1] > large[place]) and large[place] - position <= reach:
                found.append((position, large[place] - position, length))
            large.insert(place, position)
            low = place + 1
        members[one] = large
    return found


def least_prefix(least: int, exponent: int) -> int:
    """Common prefix of the first two periods of the shortest run that counts."""
    return -(-least * (exponent - 1) // exponent)


def find_runs(words: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in some numbered words, in order. Numbers of separate texts must differ."""
    if len(words) < 2:
        return []
    suffixes = sorted_suffixes(words)
    prefixes = neighbour_prefixes(words, suffixes)
    runs = []
    for start, period, prefix in seeds(suffixes, prefixes, least_prefix(least, exponent), exponent):
        if period + prefix >= least and (start == 0 or words[start - 1] != words[start - 1 + period]):
            runs.append((start, period + prefix, period))
    return sorted(runs, key=lambda run: (run[0], run[2]))


def _with_repeats(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and which texts hold some window of ``width`` words twice."""
    starts, ends, first_word = word_bounds(data, offsets)
    repeats = np.zeros(len(offsets) - 1, dtype=bool)
    windows = window_hashes(word_hashes(data, starts, ends), width)
    at = np.arange(len(windows))
    doc = np.searchsorted(first_word, at, side="right") - 1
    inside = at + width <= first_word[doc + 1] if len(at) else np.zeros(0, dtype=bool)
    doc = doc[inside]
    key = mixed(windows[inside] ^ mixed(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    repeats[doc[order][1:][same]] = True
    return np.diff(first_word), repeats


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as numbers, a number of its own after each text, and where each text starts."""
    numbers, bounds, used = [], [0], 0
    for words in texts:
        coded = pa.array(words, pa.binary()).dictionary_encode()
        numbers.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + used)
        used += len(coded.dictionary)
        numbers.append(np.array([used], dtype=np.int64))
        used += 1
        bounds.append(bounds[-1] + len(words) + 1)
    return np.concatenate(numbers), np.array(bounds)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those after the first period of any run."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[place] for place in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _run_batches(least: int, exponent: int):
    width = least_prefix(least, exponent)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for first, last, data, offsets in steps(batch.column(1)):
            counts, repeats = _with_repeats(data, offsets, width)
            text = data.tobytes()
            words = [text[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
            chosen = np.flatnonzero(repeats).tolist()
            if chosen:
                numbers, bounds = _numbered([words[place] for place in chosen])
                for start, length, period in find_runs(numbers, least, exponent):
                    place = int(np.searchsorted(bounds, start, side="right")) - 1
                    runs[chosen[place]].append((start - int(bounds[place]), length, period))
            kept = [b" ".join(collapsed(w, r) if r else w) for w, r in zip(words, runs)]
            shown = [[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs]
            columns = [
                batch.column(0).slice(first, last - first),
                pa.array(counts.astype(np.int64)),
                pa.array(shown, kind),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ]
            out.append(pa.record_batch(columns, ["doc", "n_words", "runs", "kept_text"]))
        return out

    return run


def periodic_runs(
    docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Columns doc, n_words, runs (start, length and period in words; by start, then period) and kept_text of every row.

    ``kept_text`` holds the words that no run contains after its first period, joined by one blank.
    """
    if exponent < 2:
        raise ValueError("the exponent must be at least 2")
    texts = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return map_batches(texts, _run_batches(least, exponent), SCHEMA)


def made_periodic(id: Column, text: Column) -> Column:
    """Every tenth text (by the hash of its id) repeats some of its words from a hashed place on; others are left."""
    hashed = F.crc32(id.cast("string").cast("binary"))
    g = F.floor(hashed / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        since = F.pmod(g, n)
        period = F.floor((n - since) / (F.lit(3) + F.pmod(g, F.lit(8)))) + 1
        return bind(
            F.struct(words.alias("words"), since.alias("since"), period.alias("period"), n.alias("n")),
            lambda own: F.array_join(
                F.transform(
                    F.sequence(F.lit(0).cast("long"), own["n"] - 1),
                    lambda i: F.get(
                        own["words"],
                        F.when(i < own["since"], i)
                        .otherwise(own["since"] + F.pmod(i - own["since"], own["period"]))
                        .cast("int"),
                    ),
                ),
                " ",
            ),
        )

    words = F.filter(F.split(text, BLANKS), lambda word: word != "")
    damaged = bind(words, lambda own: F.when(F.size(own) > 0, repeated(own)).otherwise(""))
    return F.when((F.pmod(hashed, F.lit(10)) == 0) & text.isNotNull(), damaged).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: runs of at least six words and four periods in every document, a tenth of them made periodic first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.reduce(
        "runs",
        none,
        lambda most, run: F.when(
            most.isNull() | (run["length"] * most["period"] > most["length"] * run["period"]), run
        ).otherwise(most),
    )
    lines = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    found = periodic_runs(docs).withColumn("best", best)
    return found.select(
        F.col("doc").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
