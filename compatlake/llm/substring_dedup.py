"""Removal of passages that an earlier document already holds, by rolling hashes of every token window.

Every window of ``width`` consecutive words gets a Rabin-Karp hash. A window whose words also start in a
document with a smaller id is removed; windows that overlap or touch merge into maximal intervals.

Counting every window of a large corpus would shuffle eight bytes or more for each word. A window can only
repeat where its *anchor* repeats: the least Rabin-Karp hash among its inner windows of ``width // 2`` words,
which depends on the window's words alone. So the first count is over the distinct anchors (about one for
every 13 words), and the second over all windows whose anchor occurs in several documents. Nothing that
could repeat is left out.

Nulls and ties: a null text has no words and gives an empty kept text. Rows with the same id are judged
alike; neither is "smaller" than the other. A null id is smaller than nothing, so such a row neither gives
nor loses passages. Documents shorter than ``width`` words are kept whole. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import (
    Stored,
    list_array,
    map_batches,
    sliding_minimum,
    steps,
    window_hashes,
    word_bounds,
    word_hashes,
)

WIDTH = 50
#: Bytes from which a word is hashed by XXH3 instead of a polynomial.
LONG_WORD = 256

_DOC = pa.int64()


class _Windows:
    """Words, window hashes and anchors of a slice of texts; windows never cross from one text into the next."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int) -> None:
        self.width = width
        self.starts, self.ends, self.first_word = word_bounds(data, offsets)
        self.words = word_hashes(data, self.starts, self.ends)
        # polynomials modulo 2**64 let very long words be made that share their hash
        for word in np.flatnonzero(self.ends - self.starts >= LONG_WORD).tolist():
            self.words[word] = xxhash.xxh3_64_intdigest(data[self.starts[word] : self.ends[word]].tobytes())
        total = max(0, len(self.words) - width + 1)
        at = np.arange(total)
        self.doc = np.searchsorted(self.first_word, at, side="right") - 1
        self.at = at[at + width <= self.first_word[self.doc + 1]] if total else at
        self.doc = self.doc[self.at]

    def anchors(self) -> np.ndarray:
        inner = max(1, self.width // 2)
        least = sliding_minimum(window_hashes(self.words, inner), self.width - inner + 1)
        return least[self.at]

    def hashes(self, which: int) -> np.ndarray:
        return window_hashes(self.words, self.width, which)[self.at]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _changes(docs: np.ndarray, values: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(docs), dtype=bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    return fresh


def _unique_pairs(docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs; neighbouring windows mostly share their anchor, so runs go before the sort."""
    fresh = _changes(docs, values)
    docs, values = docs[fresh], values[fresh]
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    fresh = _changes(docs, values)
    return docs[fresh], values[fresh]


def _anchors(width: int):
    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        ids, out = batch.column(0).to_numpy(zero_copy_only=False), []
        for first, last, data, offsets in steps(batch.column(1)):
            found = _Windows(data, offsets, width)
            if len(found.at):
                docs, anchors = _unique_pairs(found.doc, found.anchors())
                columns = [_signed(anchors), pa.array(ids[first:last][docs], _DOC)]
                out.append(pa.record_batch(columns, ["anchor", "doc"]))
        return out

    return run


def _member(docs: np.ndarray, values: np.ndarray, sets: pa.Array, first: int, last: int) -> np.ndarray:
    """Which values are in the list of their own document (lists are cut to the slice first)."""
    hit = np.zeros(len(values), dtype=bool)
    bounds = np.searchsorted(docs, np.arange(last - first + 1))
    for place in range(last - first):
        low, high = bounds[place], bounds[place + 1]
        listed = sets[first + place]
        if low < high and listed.is_valid and len(listed.values):
            own = listed.values.to_numpy(zero_copy_only=False).view(np.uint64)
            hit[low:high] = np.isin(values[low:high], own)
    return hit


def _candidates(width: int):
    """Full hashes of the windows whose anchor repeats, and whether an earlier document holds that anchor."""

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        ids, out = batch.column(0).to_numpy(zero_copy_only=False), []
        sets, later = batch.column(2), batch.column(3)
        for first, last, data, offsets in steps(batch.column(1)):
            found = _Windows(data, offsets, width)
            if not len(found.at):
                continue
            anchors = found.anchors()
            wanted = _member(found.doc, anchors, sets, first, last)
            if not wanted.any():
                continue
            docs, anchors = found.doc[wanted], anchors[wanted]
            target = _member(docs, anchors, later, first, last)
            columns = [
                _signed(found.hashes(0)[wanted]),
                _signed(found.hashes(1)[wanted]),
                pa.array(ids[first:last][docs], _DOC),
                pa.array(target),
            ]
            out.append(pa.record_batch(columns, ["w1", "w2", "doc", "target"]))
        return out

    return run


def merge_windows(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals [from, to) covered by windows that begin at the sorted ``starts``."""
    if not len(starts):
        return starts, starts
    breaks = np.flatnonzero(np.diff(starts) > width)
    return starts[np.concatenate([[0], breaks + 1])], starts[np.concatenate([breaks, [len(starts) - 1]])] + width


def _intervals(width: int):
    """For each row: number of words, and the maximal intervals of words to remove."""

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for first, last, data, offsets in steps(batch.column(1)):
            found = _Windows(data, offsets, width)
            hit = _member(found.doc, found.hashes(0), batch.column(2), first, last)
            hit &= _member(found.doc, found.hashes(1), batch.column(3), first, last)
            froms, tos, n_words, counts, kept = [], [], [], [], []
            text = data.tobytes()
            bounds = np.searchsorted(found.doc, np.arange(last - first + 1))
            for place in range(last - first):
                low, high = found.first_word[place], found.first_word[place + 1]
                own = slice(bounds[place], bounds[place + 1])
                begin, end = merge_windows(found.at[own][hit[own]], width)
                words = text[offsets[place] : offsets[place + 1]].split()
                for a, b in zip((begin - low).tolist()[::-1], (end - low).tolist()[::-1]):
                    del words[a:b]
                froms.append(begin - low)
                tos.append(end - low)
                counts.append(len(begin))
                n_words.append(high - low)
                kept.append(b" ".join(words))
            columns = [
                batch.column(0).slice(first, last - first),
                pa.array(n_words, pa.int64()),
                list_array(np.concatenate(froms), np.array(counts), pa.int64()),
                list_array(np.concatenate(tos), np.array(counts), pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ]
            out.append(pa.record_batch(columns, ["doc", "n_words", "remove_from", "remove_to", "kept_text"]))
        return out

    return run


def repeated_passages(docs: DataFrame, width: int = WIDTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc, n_words, remove_from, remove_to (word positions, end exclusive) and kept_text of every row.

    One text row is one output row. Intervals are maximal and in order; ``kept_text`` holds the other words,
    joined by one blank.
    """
    stored = Stored(docs.sparkSession, "substring-dedup")
    texts = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    known = texts.where("doc IS NOT NULL AND text IS NOT NULL")

    anchors = stored.keep(map_batches(known, _anchors(width), "anchor long, doc long"), "anchors")
    spread = anchors.groupBy("anchor").agg(F.min("doc").alias("earliest"), F.max("doc").alias("latest"))
    repeated = stored.keep(spread.where("earliest < latest").select("anchor", "earliest"), "repeated")
    later = F.when(F.col("doc") > F.col("earliest"), F.col("anchor"))
    sets = (
        anchors.join(repeated, "anchor")
        .groupBy("doc")
        .agg(F.collect_list("anchor").alias("anchors"), F.collect_list(later).alias("later"))
    )
    located = known.join(sets, "doc").select("doc", "text", "anchors", "later")
    shape = "w1 long, w2 long, doc long, target boolean"
    windows = stored.keep(map_batches(located, _candidates(width), shape), "windows")
    stored.drop("anchors", "repeated")

    first = windows.groupBy("w1", "w2").agg(F.min("doc").alias("earliest"), F.max("doc").alias("latest"))
    first = stored.keep(first.where("earliest < latest").select("w1", "w2", "earliest"), "first")
    hits = windows.where("target").join(first, ["w1", "w2"]).where("earliest < doc")
    hits = stored.keep(
        hits.groupBy("doc").agg(F.collect_set("w1").alias("h1"), F.collect_set("w2").alias("h2")), "hits"
    )
    stored.drop("windows", "first")

    whole = texts.join(hits, "doc", "left").select("doc", "text", "h1", "h2")
    schema = "doc long, n_words long, remove_from array<long>, remove_to array<long>, kept_text string"
    return map_batches(whole, _intervals(width), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: windows of 50 words over all documents."""
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate(
        F.zip_with("remove_to", "remove_from", lambda to, since: to - since), F.lit(0).cast("long"), lambda a, b: a + b
    )
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        removed.alias("n_removed"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
        F.size("remove_from").cast("long").alias("n_intervals"),
    )
