"""SimHash near duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from compatlake.llm import simhash_dedup
from compatlake.llm.graph import components

SHAPE = "doc_id long, text string, fp string, root int"


def plain(text):
    raw = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in raw).split()
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[n : n + size]), 42) for n in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(fps):
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for n, a in enumerate(fps):
        for b in fps[:n]:
            if (a ^ b).bit_count() <= 3:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {f: top(f) for f in fps}


def brute(rows):
    fps = [plain(t) for _, t in rows]
    root = roots(fps)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    return sorted([(i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps)], key=str)


def corpus(seed):
    dice = random.Random(seed)
    words = [f"W{n}é" if n % 7 == 0 else f"w{n}" for n in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [dice.choice(words) for _ in range(dice.choice([2, 30, 200, 400]))]
        for _ in range(dice.randint(1, 6)):
            copy = list(base)
            for _ in range(dice.randint(0, 3)):
                copy[dice.randrange(len(copy))] = dice.choice(words)
            rows.append((n := n + 7, "\t ".join(copy)))
    return [*rows, (3, None), (4, ""), (None, rows[5][1]), (None, "alone here"), (7, rows[40][1]), rows[50], rows[50]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SHAPE)


@pytest.mark.parametrize("limit", [1024, 2])
def test_against_brute_force(spark, limit):
    rows = corpus(limit)
    got = simhash_dedup.near_duplicates(frame(spark, rows), limit=limit).collect()
    assert sorted([(r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in got], key=str) == brute(rows)


@pytest.mark.parametrize("limit", [1024, 3])
def test_links_of_close_fingerprints(spark, limit):
    """Clusters around few centres, with distances of one to four bits in and across the blocks."""
    dice = np.random.default_rng(limit)
    fps = set()
    for centre in dice.integers(0, 1 << 63, 6).tolist():
        for _ in range(60):
            other = centre
            for bit in dice.integers(0, 64 if dice.random() < 0.5 else 22, dice.integers(0, 6)).tolist():
                other ^= 1 << bit
            fps.add(other)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash_dedup.links(spark.createDataFrame(signed, "fp long"), limit)
    found = {r.node % 2**64: r.root for r in components(edges).collect()}
    want = roots(fps)
    groups = {}
    for f in fps:
        groups.setdefault(found.get(f, f), set()).add(want[f])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(want.values()))


def test_long_chain_and_star(spark):
    edges = [(n, n + 1) for n in range(300)] + [(1000, 1000 + n) for n in range(500)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(301)} | {1000 + n: 1000 for n in range(500)}


def test_no_rows(spark):
    assert simhash_dedup.near_duplicates(frame(spark, [])).collect() == []


def test_representatives(spark):
    rows = corpus(9)
    kept = simhash_dedup.representatives(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "root"]
    got = [(r.doc_id, plain(r.text)) for r in kept.collect()]
    root = roots([plain(t) for _, t in rows])
    assert sorted(root[f] for _, f in got) == sorted(set(root.values()))
    want = {(i, c) for i, _, c in brute(rows)}
    assert all((i, i) in want for i, _ in got)
