"""Near duplicates by SimHash, with meet-in-the-middle ball hashing for fingerprints within three bits.

A fingerprint bit is the majority of that bit over the XXH64 hashes of all word shingles. Two fingerprints at
distance two share a variant if both emit every flip of one bit (half the radius). For the odd third bit, the
64 positions form three blocks: for each block the fingerprint is emitted with that block left out and every
flip of one other bit. Of three differing bits at least one lies in some block, and with that block left out
the others meet. So 130 variants a distinct fingerprint find all pairs, where flips of two bits on one side
would take 2,081. Colliding fingerprints are compared in full; a bucket gives a spanning star of each group
linked within it instead of all pairs, and the stars' components are the groups of near duplicates.

A bucket of more than ``limit`` distinct fingerprints is dealt anew by the bits that it left out: its members
emit the flips of one and, where no other bit is flipped, two of those. Each such point has at most 1,243
members, however large the bucket was, and every pair within three bits meets in one.

A null or blank text has fingerprint zero, which links like any other. Rows with equal ids or texts keep their
own output row. A null id never is a component's id unless no member has another. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import Stored, free_name, map_batches
from .graph import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: The blocks of bit positions, of which one is left out at a time.
BLOCKS = ((0, 22), (22, 43), (43, 64))
#: Distinct fingerprints which a bucket compares directly.
LIMIT = 1024


# --- fingerprints -------------------------------------------------------------------------------


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of one text; words are lower-cased in A-Z only."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 65_536):
        bounds = zip(starts[at : at + 65_536].tolist(), ends[at : at + 65_536].tolist())
        hashes = np.array([digest(line[a:b], SEED) for a, b in bounds], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in np.flatnonzero(2 * counts > len(starts)).tolist())


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, text_key (a hash that tells rows of one id apart) and fp (64 bits in a long) of each row."""

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        found = np.array([fingerprint(t.as_py() or b"") for t in batch.column(2)], dtype=np.uint64)
        return [pa.record_batch([*batch.columns[:2], pa.array(found.view(np.int64))], ["doc_id", "text_key", "fp"])]

    texts = docs.select(
        F.col(id).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text).cast("string")).alias("text_key"),
        F.col(text).cast("string").cast("binary").alias("text"),
    )
    return map_batches(texts, run, "doc_id long, text_key long, fp long")


# --- buckets ------------------------------------------------------------------------------------


def _block(which: int) -> int:
    low, high = BLOCKS[which]
    return ((1 << high) - 1) ^ ((1 << low) - 1)


def _mark(which: int) -> int:
    """Stands in the place of the block that is left out, so that a key tells which one it is."""
    return (which + 1) << BLOCKS[which][0]


def _flips(bits: list[int], pairs: bool = False) -> np.ndarray:
    """No flip, each single one, and each two if asked for."""
    out = [0, *(1 << b for b in bits)]
    if pairs:
        out += [(1 << a) | (1 << b) for n, a in enumerate(bits) for b in bits[:n]]
    return np.array(out, dtype=np.uint64)


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and fingerprints of all buckets that these fingerprints fall in."""
    keys, owners = [], []
    for which, (low, high) in enumerate(BLOCKS):
        flips = _flips([b for b in range(64) if not low <= b < high])
        rest = (fps & np.uint64(~_block(which) % (1 << 64))) | np.uint64(_mark(which))
        keys.append((rest[:, None] ^ flips[None, :]).ravel())
        owners.append(np.repeat(fps, len(flips)))
    return np.concatenate(keys), np.concatenate(owners)


def points(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Finer keys for members of large buckets: the bits left out come back, with one or two flips among them."""
    out_keys, owners = [], []
    for which, (low, high) in enumerate(BLOCKS):
        block = np.uint64(_block(which))
        moved = np.bitwise_count((keys ^ fps) & ~block)
        here = ((keys & block) == np.uint64(_mark(which))) & (moved <= 1)
        for flips, chosen in (
            (_flips(list(range(low, high))), here),
            (_flips(list(range(low, high)), pairs=True)[1 + high - low :], here & (moved == 0)),
        ):
            base = (keys[chosen] & ~block) | (fps[chosen] & block)
            out_keys.append((base[:, None] ^ flips[None, :]).ravel())
            owners.append(np.repeat(fps[chosen], len(flips)))
    return np.concatenate(out_keys), np.concatenate(owners)


def star(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct fingerprints of one bucket: the least of each group linked within it, and its other members."""
    fps = np.unique(fps)
    labels = np.arange(len(fps))
    while True:
        fresh = labels.copy()
        for at in range(0, len(fps), 512):
            near = np.bitwise_count(fps[at : at + 512, None] ^ fps[None, :]) <= RADIUS
            fresh[at : at + 512] = np.where(near, labels[None, :], len(fps)).min(axis=1)
        fresh = fresh[fresh]
        if (fresh == labels).all():
            break
        labels = fresh
    others = labels != np.arange(len(fps))
    return fps[labels[others]], fps[others]


def _collide(limit: int | None):
    """Links of each run of equal keys; runs over the limit are handed on as (key, fp) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, over = None, np.zeros(0, dtype=np.uint64), False

        def made(a, b, key=None):
            none = pa.nulls(len(a), pa.int64())
            key = none if key is None else pa.array(key.view(np.int64))
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), key], ["a", "b", "key"])

        def closed(fps, key, over):
            if over:
                return made(fps, fps, np.full(len(fps), key, dtype=np.uint64))
            return made(*star(fps))

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            if held_key is not None:
                keys = np.concatenate([np.full(len(held), held_key, dtype=np.uint64), keys])
                fps = np.concatenate([held, fps])
            bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            whole = bounds[:-1]
            sizes = np.diff(bounds)
            over = over and keys[0] == held_key
            if over and len(sizes) > 1:
                yield closed(fps[: bounds[1]], keys[0], True)
            begin = 1 if over else 0
            ended = slice(begin, len(sizes) - 1)
            two = whole[ended][sizes[ended] == 2]
            a, b = np.minimum(fps[two], fps[two + 1]), np.maximum(fps[two], fps[two + 1])
            near = (np.bitwise_count(a ^ b) <= RADIUS) & (a != b)
            if near.any():
                yield made(a[near], b[near])
            for at, size in zip(whole[ended][sizes[ended] > 2].tolist(), sizes[ended][sizes[ended] > 2].tolist()):
                yield closed(fps[at : at + size], keys[at], limit is not None and size > limit)
            held_key, held = keys[-1], fps[whole[-1] :]
            over = over and len(sizes) == 1
            if over or (limit is not None and len(held) > limit):
                over = True
                yield closed(held, held_key, True)
                held = held[:0]
        if held_key is not None and len(held) > 1 and not over:
            yield closed(held, held_key, False)

    return run


def _met(rows: DataFrame, limit: int | None) -> DataFrame:
    """``rows`` (key, fp) brought together by key. One task takes its keys one after the other, in order."""
    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_collide(limit), "a long, b long, key long")


def _spread(function):
    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = []
        for at in range(0, batch.num_rows, 4096):
            part = [c.slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            keys, fps = function(*part)
            out.append(pa.record_batch([pa.array(keys.view(np.int64)), pa.array(fps.view(np.int64))], ["key", "fp"]))
        return out

    return run


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs a, b that connect all distinct fingerprints ``fp`` within three bits, directly or through others."""
    stored = Stored(fps.sparkSession, "simhash-links")
    met = stored.keep(_met(map_batches(fps, _spread(variants), "key long, fp long"), limit), "met")
    direct = met.where("key IS NULL").select("a", "b")
    large = met.where("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    finer = map_batches(large, _spread(points), "key long, fp long")
    return direct.unionByName(_met(finer, None).select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Columns doc_id, text_key, fp, root (tells components apart) and component_id: the smallest id that links reach."""
    stored = Stored(docs.sparkSession, "simhash")
    rows = stored.keep(fingerprints(docs, id, text), "rows")
    fps = stored.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fps")
    roots = stored.keep(components(links(fps.select("fp"), limit)), "roots")
    placed = fps.join(roots, F.col("fp") == F.col("node"), "left")
    placed = stored.keep(placed.select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "placed")
    least = stored.keep(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    named = stored.keep(placed.join(least, "root").select("fp", "root", "component_id"), "named")
    stored.drop("fps", "roots", "placed", "least")
    return rows.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: the smallest id of each component, once.

    Rows without an id stay only where no member of their component has one.
    """
    own, key, number = free_name(docs, "_component", "_text_key", "_number")
    stays = near_duplicates(docs, id, text).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = stays.groupBy("root").agg(F.min("doc_id").alias(own), F.min("text_key").alias(f"{key}_kept"))
    stays = Stored(docs.sparkSession, "simhash-kept").keep(stays.drop("root"), "kept")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text).cast("string")))
    same = (F.col(key) == F.col(f"{key}_kept")) & F.col(id).cast("long").eqNullSafe(F.col(own))
    once = Window.partitionBy(key, id).orderBy(id)
    met = keyed.join(stays, same, "left_semi").withColumn(number, F.row_number().over(once))
    return met.where(F.col(number) == 1).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: three-word shingles of all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
