"""Exact duplicates of a new batch against immutable snapshots, screened by static filters.

A snapshot is written once: its distinct digests with their first document and count, in buckets by digest, and
for each shard of the digest range a static binary-fuse filter (three cells a key, eight bits a cell). Digests of
a new batch are grouped among themselves first; the distinct ones ask the filter of their shard, and only the
positives join the snapshot's exact buckets. The texts of each pair found there are compared byte for byte, so
that neither a filter's false positive nor a colliding digest ever merges two different texts.

Texts are equal if they are identical after each run of blanks is replaced by one space; a null text counts as
empty. Of equal texts the row with the smallest id stays. Rows repeated with their id form one row that stays
and copies that go. A null id is larger than any other: such a row stays only where no row of its group has an
id. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BLANKS, Stored, free_name, mixed, text_or_empty

#: Distinct digests that share one filter, and digests that one task asks of it.
SHARD_KEYS = 1 << 16
SLICE_KEYS = 1 << 18

_FILTER = "shard int, seed long, segment int, segments int, cells binary"


# --- the filter ---------------------------------------------------------------------------------


@dataclass
class FuseFilter:
    """A static set of 64-bit keys: three cells, one in each of three neighbouring segments, whose XOR is the key's mark."""

    seed: int
    segment: int
    segments: int
    cells: np.ndarray

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The three cells (3, n) and the mark of each key."""
        scrambled = mixed(keys + np.uint64(self.seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        reach = np.uint64(self.segments * self.segment)
        first = ((scrambled >> np.uint64(32)) * reach) >> np.uint64(32)
        low = np.uint64(self.segment - 1)
        second = (first + np.uint64(self.segment)) ^ ((scrambled >> np.uint64(18)) & low)
        third = (first + np.uint64(2 * self.segment)) ^ (scrambled & low)
        marks = (scrambled ^ (scrambled >> np.uint64(32))).astype(np.uint8)
        return np.stack([first, second, third]).astype(np.int64), marks

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], dtype=np.uint64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.cells):
            return np.zeros(len(keys), dtype=bool)
        places, marks = self.places(keys)
        return (self.cells[places[0]] ^ self.cells[places[1]] ^ self.cells[places[2]]) == marks


def _peel(places: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the cell each has for itself); None if some keys can't be set apart."""
    n = places.shape[1]
    count = np.bincount(places.ravel(), minlength=size)
    total = np.bincount(places.ravel(), weights=np.tile(np.arange(n), 3), minlength=size).astype(np.int64)
    rounds, left = [], n
    alone = np.flatnonzero(count == 1)
    while len(alone):
        keys, where = np.unique(total[alone], return_index=True)
        rounds.append((keys, alone[where]))
        left -= len(keys)
        touched = places[:, keys].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(total, touched, np.tile(keys, 3))
        touched = np.unique(touched)
        alone = touched[count[touched] == 1]
    return None if left else rounds


def build_filter(keys: np.ndarray) -> FuseFilter:
    """The filter of some keys; sizes follow the published construction, another seed is tried if one fails."""
    keys = np.unique(keys)
    n = len(keys)
    if not n:
        return FuseFilter(0, 1, 1, np.zeros(0, dtype=np.uint8))
    spread = max(n, 2)
    segment = 1 << max(2, math.floor(math.log(spread) / math.log(3.33) + 2.25))
    room = spread * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(spread))
    segments = max(1, math.ceil(room / segment) - 2)
    for seed in range(1, 1000):
        if seed % 20 == 0:
            segments += max(1, segments // 10)
        made = FuseFilter(seed, segment, segments, np.zeros((segments + 2) * segment, dtype=np.uint8))
        places, marks = made.places(keys)
        rounds = _peel(places, len(made.cells))
        if rounds is None:
            continue
        for peeled, own in reversed(rounds):
            first, second, third = places[:, peeled]
            made.cells[own] = marks[peeled] ^ made.cells[first] ^ made.cells[second] ^ made.cells[third]
        return made
    raise ValueError("no seed sets these keys apart")


# --- snapshots ----------------------------------------------------------------------------------


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), BLANKS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _key() -> Column:
    return F.xxhash64("digest")


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftright(_key(), 20), F.lit(shards)).cast("int")


@dataclass
class Batch:
    """Some documents with the digest of each row, and each distinct digest with its first id and count."""

    docs: DataFrame
    rows: DataFrame
    groups: DataFrame
    id: str
    text: str
    digest: Callable[[Column], Column]


@dataclass
class Snapshot(Batch):
    """A batch made immutable: its filters, one for each shard of the digest range."""

    filters: DataFrame
    shards: int


def batch(docs: DataFrame, id: str = "doc_id", text: str = "text", digest=sha256, name: str = "exact-batch") -> Batch:
    """Digest every row once and group equal digests, with partial sums before the shuffle."""
    stored = Stored(docs.sparkSession, name)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), digest(normalised(text)).alias("digest"))
    rows = stored.keep(rows, "rows")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return Batch(docs, rows, stored.keep(groups, "groups"), id, text, digest)


def _filters(groups: DataFrame, shards: int) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        made = build_filter(table["key"].to_numpy().view(np.uint64))
        return pa.table(
            {
                "shard": table["shard"].slice(0, 1).cast(pa.int32()),
                "seed": pa.array([made.seed], pa.int64()),
                "segment": pa.array([made.segment], pa.int32()),
                "segments": pa.array([made.segments], pa.int32()),
                "cells": pa.array([made.cells.tobytes()], pa.binary()),
            }
        )

    keyed = groups.select(_shard(shards).alias("shard"), _key().alias("key"))
    return keyed.groupBy("shard").applyInArrow(build, _FILTER)


def snapshot(docs: DataFrame, id: str = "doc_id", text: str = "text", digest=sha256) -> Snapshot:
    """Write the digests, groups and filters of some documents; nothing changes them afterwards."""
    made = batch(docs, id, text, digest, "exact-snapshot")
    shards = max(1, math.ceil(made.groups.count() / SHARD_KEYS))
    filters = Stored(docs.sparkSession, "exact-filters").keep(_filters(made.groups, shards), "filters")
    return Snapshot(**vars(made), filters=filters, shards=shards)


def screened(groups: DataFrame, against: Snapshot) -> DataFrame:
    """The digests which the snapshot may hold. Shards with more questions than a task should take are sliced."""
    slices = max(1, math.ceil(groups.count() / (against.shards * SLICE_KEYS)))
    asked = groups.select(
        "digest",
        _key().alias("key"),
        _shard(against.shards).alias("shard"),
        F.pmod(_key(), F.lit(slices)).cast("int").alias("slice"),
    )
    copies = against.filters.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def ask(keys: pa.Table, filters: pa.Table) -> pa.Table:
        held = np.zeros(len(keys), dtype=bool)
        for row in filters.to_pylist():
            cells = np.frombuffer(row["cells"], dtype=np.uint8)
            made = FuseFilter(row["seed"], row["segment"], row["segments"], cells)
            held |= made.contains(keys["key"].to_numpy().view(np.uint64))
        return keys.select(["digest"]).filter(pa.array(held))

    return (
        asked.groupBy("shard", "slice")
        .cogroup(copies.groupBy("shard", "slice"))
        .applyInArrow(ask, "digest string")
    )


def _first_texts(side: Batch, pairs: DataFrame, ids: str, name: str) -> DataFrame:
    """The normalised text of each wanted first row."""
    docs = side.docs.select(F.col(side.id).cast("long").alias("_id"), normalised(side.text).alias(name))
    wanted = pairs.select("digest", F.col(ids).alias("_id"))
    known = docs.join(wanted, "_id").where(side.digest(F.col(name)) == F.col("digest"))
    # rows without an id are all alike in it, so these are met by digest
    bare = docs.where("_id IS NULL").withColumn("digest", side.digest(F.col(name)))
    bare = bare.join(wanted.where("_id IS NULL").select("digest"), "digest")
    met = known.select("digest", name).unionByName(bare.select("digest", name))
    return met.groupBy("digest").agg(F.min(name).alias(name))


def matches(new: Batch, against: Snapshot) -> DataFrame:
    """Digests of the batch whose text the snapshot holds, with both sides' first ids and counts."""
    held = against.groups.select("digest", F.col("first_id").alias("held_id"), F.col("n").alias("held_n"))
    stored = Stored(new.docs.sparkSession, "exact-matches")
    pairs = screened(new.groups, against).join(held, "digest").join(new.groups, "digest")
    pairs = stored.keep(pairs, "pairs")
    mine, theirs = _first_texts(new, pairs, "first_id", "mine"), _first_texts(against, pairs, "held_id", "theirs")
    same = mine.join(theirs, "digest").where("mine = theirs").select("digest")
    return stored.keep(pairs.join(same, "digest"), "matches")


def deduplicate(new: Batch, against: Snapshot) -> DataFrame:
    """One row per row of batch and snapshot: doc_id, digest, in_snapshot, keep_id, group_size, kept."""
    met = matches(new, against)
    found = met.select("digest", "held_id", "held_n", F.col("first_id").alias("new_id"), F.col("n").alias("new_n"))
    stays_new = F.col("new_id").isNotNull() & (F.col("held_id").isNull() | (F.col("new_id") < F.col("held_id")))
    matched = F.col("held_n").isNotNull()

    def groups(side: Batch, in_snapshot: bool) -> DataFrame:
        here = ~stays_new if in_snapshot else stays_new
        return side.groups.join(found, "digest", "left").select(
            "digest",
            F.lit(in_snapshot).alias("in_snapshot"),
            F.when(matched, F.when(stays_new, F.col("new_id")).otherwise(F.col("held_id")))
            .otherwise(F.col("first_id"))
            .alias("keep_id"),
            F.when(matched, F.col("held_n") + F.col("new_n")).otherwise(F.col("n")).alias("group_size"),
            F.when(matched, here).otherwise(F.lit(True)).alias("_here"),
        )

    stored = Stored(new.docs.sparkSession, "exact-groups")
    known = stored.keep(groups(new, False).unionByName(groups(against, True)), "groups")
    rows = new.rows.withColumn("in_snapshot", F.lit(False)).unionByName(
        against.rows.withColumn("in_snapshot", F.lit(True))
    )
    rows = rows.groupBy("in_snapshot", "digest", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    joined = rows.join(known, ["in_snapshot", "digest"])
    first = F.col("_here") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(
        "doc_id", "digest", "in_snapshot", "keep_id", "group_size", (first & (F.col("_copy") == 1)).alias("kept")
    )


def halves(docs: DataFrame, id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """A standing snapshot and a new batch, told apart by a hash of the id; equal rows fall on one side."""
    side = F.pmod(F.xxhash64(F.col(id).cast("long")), F.lit(2)) == 0
    return docs.where(side), docs.where(~side)


def distinct(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, each exactly once."""
    held, new = halves(docs, id)
    found = deduplicate(batch(new, id, text), snapshot(held, id, text))
    stay = Stored(docs.sparkSession, "exact-kept").keep(found.where("kept").select("digest", "doc_id"), "kept")
    digest, own, number = free_name(docs, "_digest", "_kept_id", "_number")
    keyed = docs.withColumn(digest, sha256(normalised(text)))
    stay = stay.select(F.col("digest").alias(digest), F.col("doc_id").alias(own))
    right = stay.withColumnRenamed(digest, f"{digest}_kept")
    same = (F.col(digest) == F.col(f"{digest}_kept")) & F.col(id).cast("long").eqNullSafe(F.col(own))
    once = Window.partitionBy(digest).orderBy(id)
    return keyed.join(right, same, "left_semi").withColumn(number, F.row_number().over(once)).where(
        F.col(number) == 1
    ).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: half of the documents are the standing snapshot, the others the new batch; all rows are returned."""
    held, new = halves(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = deduplicate(batch(new), snapshot(held))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
ORACLE = f"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (same ORDER BY doc_id) = 1 AS kept, sha256({_NORM}) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY {_NORM})
"""
