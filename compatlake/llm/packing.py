"""Best-fit packing of documents into bins of a fixed number of tokens, with conflicts.

No bin holds two documents of one source, nor two of one duplicate cluster. The documents are dealt by a hash of
their row into shards of a bounded size, and each shard is packed by itself, longest documents first (best fit
decreasing). A shard keeps its open bins by residual capacity, with a bitmap of the residuals that occur; each bin
carries bitmaps of the sources and clusters it holds. For each document a successor search goes up through the
residuals from the smallest that is large enough, until it meets the tightest bin with no conflict; bins of one
residual are tried in the order in which they came to it. If none fits, a bin is opened.

A document longer than a bin is cut: its first pieces fill bins of their own, the last one is packed. Nothing is
dropped. A document without tokens is one piece of length 0 and takes part like any other. Documents with a
null source (or cluster) have none in common. Equal rows are packed separately; ids need not be unique. Ties in
length go to the smaller id, nulls first, then to the smaller source and cluster.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, Stored, text_or_empty
from .exact_dedup import normalised

CAPACITY = 2048
#: Documents of a shard. Sources keep bins apart, so a search may pass many bins of a shard; small shards bound it.
SHARD_ROWS = 4096

_PIECES = "doc_id long, piece int, start long, n_tokens long, bin string, offset long"


class Bins:
    """Open bins of one shard, ordered by residual."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.levels: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)
        self.occupied = 0
        self.count = 0

    def _open(self, number: int, residual: int, sources: int, clusters: int) -> None:
        if residual:
            self.levels[residual][number] = (sources, clusters)
            self.occupied |= 1 << residual

    def _close(self, number: int, residual: int) -> None:
        level = self.levels[residual]
        del level[number]
        if not level:
            self.occupied &= ~(1 << residual)

    def _tightest(self, size: int, source: int, cluster: int) -> tuple[int, int] | None:
        """Bin and residual of the tightest compatible bin."""
        above = self.occupied >> size << size
        while above:
            lowest = above & -above
            residual = lowest.bit_length() - 1
            for number, (sources, clusters) in self.levels[residual].items():
                if not (sources & source or clusters & cluster):
                    return number, residual
            above ^= lowest
        return None

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Put one piece away; its bin and the offset there. ``source`` and ``cluster`` are single bits, or 0."""
        found = self._tightest(size, source, cluster)
        if found is None:
            number, residual, sources, clusters = self.count, self.capacity, 0, 0
            self.count += 1
        else:
            number, residual = found
            sources, clusters = self.levels[residual][number]
            self._close(number, residual)
        self._open(number, residual - size, sources | source, clusters | cluster)
        return number, self.capacity - residual


def _bits(values: list, shared_only: bool) -> list[int]:
    """A bit for each value, the same for equal ones; none for null and, if asked, for values that occur once."""
    times: dict = defaultdict(int)
    for value in values:
        times[value] += 1
    place = {v: n for n, v in enumerate(v for v, k in times.items() if v is not None and (k > 1 or not shared_only))}
    return [1 << place[v] if v in place else 0 for v in values]


def pack_shard(rows: list[tuple], capacity: int) -> list[tuple]:
    """(place in ``rows``, piece, start, tokens, bin, offset) of each piece of rows (id, source, cluster, tokens)."""
    bins, out, rest = Bins(capacity), [], []
    sources, clusters = _bits([r[1] for r in rows], False), _bits([r[2] for r in rows], True)
    for at, (_, _, _, tokens) in enumerate(rows):
        whole = max(0, math.ceil(tokens / capacity) - 1)
        for piece in range(whole):
            out.append((at, piece, piece * capacity, capacity, bins.count, 0))
            bins.count += 1
        rest.append((tokens - whole * capacity, at, whole))

    def order(entry: tuple) -> tuple:
        size, at, _ = entry
        doc, source, cluster, tokens = rows[at]
        return (-size, doc is not None, doc or 0, source or "", cluster or 0, tokens)

    for size, at, piece in sorted(rest, key=order):
        number, offset = bins.place(size, sources[at], clusters[at])
        out.append((at, piece, piece * capacity, size, number, offset))
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pieces of the documents in ``rows`` (doc_id, source, cluster, n_tokens): their place in the text and in a bin.

    Only ids, labels and lengths are shuffled. The number of shards follows the number of rows, and rows are dealt
    by a hash of all their columns and a random number made once, so that neither a common source nor repeated rows
    make one shard large.
    """
    stored = Stored(rows.sparkSession, "packing")
    salted = stored.keep(rows.select("doc_id", "source", "cluster", "n_tokens", F.rand(7).alias("salt")), "rows")
    shards = max(1, math.ceil(salted.count() / shard_rows))
    shard = F.pmod(F.xxhash64("doc_id", "source", "cluster", "n_tokens", "salt"), F.lit(shards)).cast("int")

    def packed(table: pa.Table) -> pa.Table:
        number = table["shard"][0].as_py()
        held = list(zip(*(table[c].to_pylist() for c in ("doc_id", "source", "cluster", "n_tokens"))))
        done = pack_shard(held, capacity)
        columns = list(zip(*done))
        return pa.table(
            {
                "doc_id": pa.array([held[at][0] for at in columns[0]], pa.int64()),
                "piece": pa.array(columns[1], pa.int32()),
                "start": pa.array(columns[2], pa.int64()),
                "n_tokens": pa.array(columns[3], pa.int64()),
                "bin": pa.array([f"{number}-{b}" for b in columns[4]], pa.string()),
                "offset": pa.array(columns[5], pa.int64()),
            }
        )

    return salted.withColumn("shard", shard).groupBy("shard").applyInArrow(packed, _PIECES)


def words(text: str = "text") -> Column:
    """Number of runs of characters other than blanks."""
    whole = text_or_empty(text)
    inner = F.regexp_replace(F.regexp_replace(whole, f"^{BLANKS}", ""), f"{BLANKS}$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, BLANKS, -1))).cast("long")


def documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows to pack: tokens are words, and equal normalised texts form a duplicate cluster."""
    return docs.select(
        F.col(id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.xxhash64(normalised(text)).alias("cluster"),
        words(text).alias("n_tokens"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all documents in bins of 2,048 words."""
    return pack(documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
