"""Packing against a plain best fit, and its rules over whole tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from compatlake.llm import packing

SHAPE = "doc_id long, source string, cluster long, n_tokens long"


def plain(rows, capacity):
    """Best fit by looking at all bins; pieces as (place, piece, start, tokens, bin, offset)."""
    bins, out, rest = [], [], []
    for at, (_, _, _, tokens) in enumerate(rows):
        piece = 0
        while tokens - piece * capacity > capacity:
            out.append((at, piece, piece * capacity, capacity, len(bins), 0))
            bins.append([0, set(), set(), 0])
            piece += 1
        rest.append((tokens - piece * capacity, at, piece))
    clock = 0
    rest.sort(key=lambda r: (-r[0], rows[r[1]][0] is not None, rows[r[1]][0] or 0, rows[r[1]][1] or "", rows[r[1]][2] or 0))
    for size, at, piece in rest:
        _, source, cluster, _ = rows[at]
        clock += 1
        fits = [
            (b[0], b[3], n)
            for n, b in enumerate(bins)
            if b[0] >= size and b[0] > 0 and not (source is not None and source in b[1]) and not (cluster is not None and cluster in b[2])
        ]
        if fits:
            number = min(fits)[2]
        else:
            number = len(bins)
            bins.append([capacity, set(), set(), 0])
        bin_ = bins[number]
        out.append((at, piece, piece * capacity, size, number, capacity - bin_[0]))
        bin_[0] -= size
        bin_[1].add(source)
        bin_[2].add(cluster)
        bin_[3] = clock
    return out


@pytest.mark.parametrize("seed", range(6))
def test_against_plain(seed):
    dice = random.Random(seed)
    rows = [
        (
            n if n % 20 else None,
            dice.choice(["a", "a", "a", "b", "c", "d", None]),
            dice.choice([None, 1, 2, 3, n + 100]),
            dice.choice([0, 1, 5, 50, 99, 100, 101, 250, 1000, dice.randint(0, 120)]),
        )
        for n in range(300)
    ]
    assert packing.pack_shard(rows, 100) == plain(rows, 100)


def rules(rows, pieces, capacity):
    """No piece is missing, no bin too full, no offset taken twice, no conflict. ``rows``: id -> (source, cluster, tokens)."""
    held, length = defaultdict(list), Counter()
    for p in pieces:
        held[p.bin].append(p)
        length[p.doc_id] += p.n_tokens
    assert length == Counter({i: t for i, (_, _, t) in rows.items()})
    assert {p.doc_id for p in pieces} == set(rows)
    for own in held.values():
        own.sort(key=lambda p: (p.offset, p.n_tokens))
        at = 0
        for p in own:
            assert p.offset == at
            at += p.n_tokens
        assert at <= capacity
        for what in (0, 1):
            known = [rows[p.doc_id][what] for p in own if rows[p.doc_id][what] is not None]
            assert len(known) == len(set(known))


def test_shards(spark):
    dice = random.Random(1)
    rows = [(n, dice.choice(["a", "a", "b", f"s{n}"]), n % 90, dice.randint(0, 300)) for n in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, SHAPE), 100, 200).collect()
    rules({r[0]: r[1:] for r in rows}, got, 100)
    assert len({p.bin.split("-")[0] for p in got}) == 15


def test_repeated_rows_and_none(spark):
    assert packing.pack(spark.createDataFrame([], SHAPE)).collect() == []
    rows = [(1, None, None, 10)] * 50 + [(None, None, None, 0)] * 3
    got = packing.pack(spark.createDataFrame(rows, SHAPE), 100, 10).collect()
    assert sum(p.n_tokens for p in got) == 500 and len(got) == 53


def test_words(spark):
    texts = [None, "", " \n ", "a", " a  b\t", "é x y", "x " * 10_000]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    got = [r.n for r in docs.select("doc_id", packing.words().alias("n")).orderBy("doc_id").collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    clusters = {}
    rows = {}
    for r in docs:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        rows[r.doc_id] = (r.source, clusters.setdefault(text, len(clusters)), len(re.findall(r"[^\x20\x09-\x0D]+", text)))
    rules(rows, packing.query(spark, folder).collect(), packing.CAPACITY)
