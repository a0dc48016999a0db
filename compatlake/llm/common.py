"""What the operators share: stored intermediate tables, text batches, and hashing over byte buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

#: Space and the control characters between words; everything else belongs to a word.
BLANKS = r"[\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step handles; longer single texts are still handled whole.
STEP_BYTES = 1 << 20

_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Odd multipliers of the rolling polynomials, modulo 2**64.
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


# --- stored tables ------------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``; where unset, one in the shared warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


class Stored:
    """Intermediate tables of one operator call, written once to the shared folder so that lost executors cost no rerun.

    ``drop`` removes those that nothing reads any more; what the returned DataFrame reads stays until
    the owner of the folder clears it.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Column names which the table doesn't use, so that extra columns never clash."""
    used = {column.lower() for column in df.columns}
    found = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        found.append(name)
    return found


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def as_long(column: str) -> Column:
    return F.col(column).cast("long")


# --- batches of texts ---------------------------------------------------------------------------


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text array (nulls are empty) and the n + 1 offsets of its texts, without a copy where possible."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first, last) of an array holding about ``limit`` bytes each, with their bytes and offsets."""
    if not len(texts):
        return
    data, offsets = buffer_of(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list for each count, from the values in a row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def map_batches(df: DataFrame, function, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with ``function`` from a record batch to a list of record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)


# --- words and rolling hashes -------------------------------------------------------------------


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values, so that every bit depends on all bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    def to(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < length:
            size = max(length, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                factors = np.full(size, np.uint64(base), dtype=np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up[:length], self.down[:length]


_BYTE_POWERS = Powers(_BYTE_BASE)
_WORD_POWERS = tuple(Powers(base) for base in _WORD_BASES)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in some texts laid end to end, and for each text the number of its first word."""
    inside = np.concatenate([[False], ~_IS_BLANK[data], [False]])
    opens = inside[1:-1] & ~inside[:-2]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    opens[cut] = inside[1:-1][cut]
    closes = np.empty(len(data), dtype=bool)
    closes[:] = inside[1:-1] & ~inside[2:]
    closes[cut - 1] = inside[1:-1][cut - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial over its bytes, scrambled with its length."""
    up, down = _BYTE_POWERS.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    values = (sums[ends] - sums[starts]) * down[starts]
    return mixed(values ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))


def window_hashes(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Rabin-Karp hash of each run of ``width`` words, by one pass of prefix sums; empty if there are fewer."""
    if len(words) < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = _WORD_POWERS[which].to(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    values = (sums[width:] - sums[:-width]) * down[: len(words) - width + 1]
    return mixed(values + np.uint64(which))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    if len(values) < width:
        return values[:0]
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values
