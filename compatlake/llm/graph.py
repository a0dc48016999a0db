"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Stored


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x


def _stars(edges: DataFrame, stored: Stored, name: str) -> DataFrame:
    """Each edge moved to the least neighbour of its upper end; stored minima let a hub's rows be split."""
    least = stored.keep(edges.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """Columns node, root (the least node of its component), for all ends of edges ``a``, ``b``.

    Rounds of large stars (every node hands its larger neighbours to its least one) and small stars (smaller
    neighbours and itself) take a number of rounds that grows with the logarithm of the longest chain. No
    neighbourhood is ever gathered: minima are pre-aggregated and edges stay rows. Each round is written to
    the shared folder.
    """
    stored = Stored(edges.sparkSession, "components")
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stored.keep(ends, "0")
    mark, step = _mark(now), 0
    while mark[0]:
        step += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, stored, f"{step}-large").where("v > u")
        large = large.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = stored.keep(large, f"{step}-stars")
        small = _stars(large, stored, f"{step}-small")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = stored.keep(moved.union(small.select("u", F.col("m").alias("v"))).distinct(), str(step))
        stored.drop(str(step - 1), f"{step}-large-least", f"{step}-stars", f"{step}-small-least")
        now, last, mark = fresh, mark, _mark(fresh)
        if mark == last:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
