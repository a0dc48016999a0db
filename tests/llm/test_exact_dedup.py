"""Exact duplicates against a brute-force version; the filter against a set."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from compatlake.llm import exact_dedup

SHAPE = "doc_id long, text string, digest string, kept int"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[norm(text)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        used = False
        for i in ids:
            kept = i == keep and not used
            used |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 70_000])
def test_filter(n):
    dice = np.random.default_rng(n)
    keys = dice.integers(0, 1 << 63, n, dtype=np.uint64)
    made = exact_dedup.build_filter(np.concatenate([keys, keys[: n // 2]]))
    assert made.contains(keys).all()
    others = dice.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert made.contains(others).mean() < 0.01
    assert len(made.cells) < 1.6 * n + 64


def rows():
    found = [(i, f"text {i % 17}" + " \t" * (i % 3)) for i in range(200)]
    found += [(7, None), (3, ""), (None, "text 4"), (None, "alone"), (None, "alone"), (50, "text 16"), (50, "text 16")]
    found += [(1000, "x " * 50_000), (1001, "x\n" * 50_000), (1002, " lead"), (1003, "lead")]
    return found


def got(frame):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in frame.collect()], key=str)


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows()], SHAPE)
    held, new = exact_dedup.halves(docs)
    assert got(exact_dedup.deduplicate(exact_dedup.batch(new), exact_dedup.snapshot(held))) == brute(rows())


@pytest.mark.parametrize("split", [0, 210])
def test_an_empty_side(spark, split):
    docs = rows()
    held = spark.createDataFrame([(i, t, "x", 1) for i, t in docs[:split]], SHAPE)
    new = spark.createDataFrame([(i, t, "x", 1) for i, t in docs[split:]], SHAPE)
    assert got(exact_dedup.deduplicate(exact_dedup.batch(new), exact_dedup.snapshot(held))) == brute(docs)


def test_bytes_are_compared(spark):
    """Two digests that collide across the sides keep both texts."""

    def short(text):
        return F.lit("same")

    held = spark.createDataFrame([(1, "a", "x", 1)], SHAPE)
    new = spark.createDataFrame([(2, "b", "x", 1)], SHAPE)
    sides = exact_dedup.batch(new, digest=short), exact_dedup.snapshot(held, digest=short)
    assert [(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.deduplicate(*sides).orderBy("doc_id").collect()] == [
        (1, 1, True),
        (2, 2, True),
    ]


def test_distinct_keeps_columns(spark):
    docs = spark.createDataFrame([(i, t, str(i), 1) for i, t in rows()], SHAPE)
    kept = exact_dedup.distinct(docs)
    assert kept.columns == docs.columns
    want = sorted([(r[0], r[4]) for r in brute(rows()) if r[3]], key=str)
    assert sorted([(r.doc_id, hashlib.sha256(norm(r.text).encode()).hexdigest()) for r in kept.collect()], key=str) == want


def test_rows_without_ids_on_both_sides(spark):
    """Rows without an id meet by digest, not each with each."""
    held = [(None, f"t{n}") for n in range(300)] + [(1, "t5"), (2, "t900")]
    new = [(None, f"t{n}") for n in range(200, 500)] + [(3, "t5"), (None, "t900"), (9, "t250")]
    frames = [spark.createDataFrame([(i, t, "x", 1) for i, t in side], SHAPE) for side in (held, new)]
    found = exact_dedup.deduplicate(exact_dedup.batch(frames[1]), exact_dedup.snapshot(frames[0]))
    assert [row[:3] + row[4:] for row in got(found)] == [row[:3] + row[4:] for row in brute(held + new)]
    named = {row for row in got(found) if row[1] is not None}
    assert named == {row for row in map(tuple, brute(held + new)) if row[1] is not None}
