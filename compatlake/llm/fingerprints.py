"""Document fingerprints: quartile digests of hashed byte triplets, and a bounded score of their difference.

The bytes of a text give triplets (each byte with the two before it), which are hashed into 256 buckets. The digest holds two bits for each bucket, the quartile of its count among all
buckets, and a head with the text's length on a logarithmic scale. Two digests differ by the sum of their quartile
steps (with extra weight for opposite quartiles) and of their length steps, cut at a bound. Likeness is 1 for equal
digests and 0 at the bound.

A null text is empty. Texts of under three bytes have no triplet: all quartiles are 0. Texts are read in pieces,
so that very long ones need little memory. Equal texts have equal digests.

``with_next`` brings every document together with the next one in descending order of id (after the last, the
first). Rows with equal ids are ordered by their texts, nulls first; rows without an id come last. Ranges of
ids are dealt to tasks by quantiles, and the first row of each range is also sent to the range before it, so that
no task holds more than its range.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BUCKETS = 256
#: Difference at which two texts have nothing in common.
MOST = 512
STEP_BYTES = 1 << 18
#: Rows of a range of ids.
RANGE_ROWS = 4096

_FACTORS = tuple(np.uint32(f) for f in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
#: Distances back of the two other bytes, for each kind of triplet that counts.
_SHAPES = ((1, 2),)


def counts(data: np.ndarray) -> np.ndarray:
    """Number of triplets in each bucket; a triplet belongs to the piece in which its last byte lies."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(data), STEP_BYTES):
        since = max(at - max(two for _, two in _SHAPES), 0)
        wide = data[since : at + STEP_BYTES].astype(np.uint32)
        products = [wide * factor for factor in _FACTORS]
        for number, (one, two) in enumerate(_SHAPES):
            first = max(two, at - since)
            if first >= len(wide):
                continue
            hashes = products[0][first:] + products[1][first - one : len(wide) - one]
            hashes += products[2][first - two : len(wide) - two]
            hashes += np.uint32(number * 0x27D4EB2F)
            hashes ^= hashes >> np.uint32(15)
            hashes *= np.uint32(0x2C1B3C6D)
            total += np.bincount(hashes >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return total


def digest(data: bytes) -> np.ndarray:
    """Length step, then the quartile (0 to 3) of every bucket."""
    found = counts(np.frombuffer(data, dtype=np.uint8))
    ordered = np.sort(found)
    bounds = [ordered[n * BUCKETS // 4 - 1] for n in (1, 2, 3)]
    step = min(255, round(math.log(len(data) + 1) / math.log(1.1)))
    return np.concatenate([[step], np.sum([found > b for b in bounds], axis=0)]).astype(np.uint8)


def text_of(made: np.ndarray) -> str:
    """Lowercase hexadecimal: one byte for the length, then four buckets a byte."""
    codes = made[1:].reshape(-1, 4)
    packed = (codes << np.array([6, 4, 2, 0], dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    return made[:1].tobytes().hex() + packed.tobytes().hex()


def digest_of(text: str) -> np.ndarray:
    """The digest which ``text_of`` wrote."""
    raw = np.frombuffer(bytes.fromhex(text), dtype=np.uint8)
    codes = (raw[1:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8)) & 3
    return np.concatenate([raw[:1], codes.ravel()])


def difference(one: np.ndarray, other: np.ndarray) -> int:
    """Sum of quartile steps, opposite quartiles counting six, and of length steps; ``MOST`` at most."""
    steps = np.abs(one.astype(np.int64) - other)
    quartiles = steps[1:]
    return min(MOST, int(quartiles.sum() + 3 * (quartiles == 3).sum() + steps[0]))


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    return 1.0 - difference(one, other) / MOST


def fingerprinted(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The documents and the digest of their texts."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_of(digest((t.as_py() or "").encode())) for t in batch.column(place)]
            yield pa.record_batch([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


# --- every document and the next ----------------------------------------------------------------


def _ranges(keys: DataFrame, ranges: int):
    """For a key: its range in descending order, and the range to which it is also sent as the first of its own (or -1)."""
    shares = [n / ranges for n in range(1, ranges)]
    cuts = keys.agg(F.percentile_approx("key", shares, 10_000).alias("cuts")).first().cuts if shares else []
    cuts = np.array(sorted(set(cuts or [])), dtype=np.int64)

    def number(key: np.ndarray) -> np.ndarray:
        return len(cuts) - np.searchsorted(cuts, key, side="right")

    numbered = F.pandas_udf(lambda key: pd.Series(number(key.to_numpy())), "long")
    tops = keys.groupBy(numbered("key").alias("range")).agg(F.max("key").alias("top")).collect()
    tops = sorted((row.range, row.top) for row in tops)
    first = np.full(len(cuts) + 1, np.iinfo(np.int64).max)
    before = np.full(len(cuts) + 1, -1)
    for at, (range_, top) in enumerate(tops):
        first[range_], before[range_] = top, tops[at - 1][0]

    @F.pandas_udf("own long, before long")
    def placed(key: pd.Series) -> pd.DataFrame:
        own = number(key.to_numpy())
        return pd.DataFrame({"own": own, "before": np.where(key.to_numpy() == first[own], before[own], -1)})

    return placed, len(cuts) + 1


def with_next(docs: DataFrame, function, schema: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows which ``function`` makes of each document's (id, text) and the next one's text, in descending order of ids.

    ``function`` gets an iterator over (id, text, next text) and yields rows of ``schema``.
    """
    key = F.coalesce(F.col(id).cast("long"), F.lit(-(2**63))).alias("key")
    keys = docs.select(key)
    placed, ranges = _ranges(keys, max(1, math.ceil(keys.count() / RANGE_ROWS)))
    rows = docs.select(key, F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("places", placed("key"))
    copies = F.array(
        F.struct(F.col("places.own").alias("range"), F.lit(False).alias("tail")),
        F.struct(F.col("places.before").alias("range"), F.lit(True).alias("tail")),
    )
    rows = rows.withColumn("copy", F.explode(F.filter(copies, lambda c: c["range"] >= 0)))
    rows = rows.select("key", "doc_id", "text", F.col("copy.range").alias("range"), F.col("copy.tail").alias("tail"))
    dealt = rows.repartitionById(ranges, F.col("range").cast("int"))
    dealt = dealt.sortWithinPartitions("range", "tail", F.desc("key"), F.col("text").asc_nulls_first())
    dealt = dealt.select("doc_id", "text", "range", "tail")
    made = T._parse_datatype_string(schema)

    def pairs(batches: Iterator[pa.RecordBatch]):
        held = None
        for batch in batches:
            columns = [column.to_pylist() for column in (batch.column(0), batch.column(2), batch.column(3))]
            for doc, value, range_, tail in zip(columns[0], batch.column(1), *columns[1:]):
                now = value.as_py() or ""
                if held and held[2] == range_:
                    yield held[0], held[1], now
                held = None if tail else (doc, now, range_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in function(pairs(batches)):
            out.append(row)
            if len(out) == 1024:
                yield pa.RecordBatch.from_pylist([dict(zip(made.names, r)) for r in out], to_arrow_schema(made))
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(made.names, r)) for r in out], to_arrow_schema(made))

    return dealt.mapInArrow(run, made)


def half_replaced(text: str, other: str) -> str:
    """The second half of a text replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _compared(pairs) -> Iterator[tuple]:
    known = (None, None)
    for doc, text, other in pairs:
        own = known[1] if known[0] is text else digest(text.encode())
        after = digest(other.encode())
        known = (other, after)
        edited = half_replaced(text, other).encode()
        changed = digest(edited)
        marks = text_of(own), text_of(changed)
        sha = hashlib.sha256(edited).hexdigest()
        yield doc, len(text), sha, *marks, likeness(own, changed), likeness(own, after)


_COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every whole text of documents, its half-replaced text and the next document."""
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"), _compared, _COMPARED)
