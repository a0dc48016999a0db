"""Fingerprints and neighbours against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from compatlake.llm import fingerprints as fp

SHAPE = "doc_id long, text string, key string, fingerprint int"


def plain_counts(data):
    total = [0] * fp.BUCKETS
    for number, (one, two) in enumerate(fp._SHAPES):
        for at in range(two, len(data)):
            h = sum(int(f) * data[at - back] for f, back in zip(fp._FACTORS, (0, one, two))) + number * 0x27D4EB2F
            h %= 1 << 32
            h ^= h >> 15
            h = h * 0x2C1B3C6D % (1 << 32)
            total[h >> (32 - fp.BUCKETS.bit_length() + 1)] += 1
    return total


@pytest.mark.parametrize("size", [0, 1, 2, 3, 4, 5, 63, 64, 65, 300, 1000])
def test_counts(monkeypatch, size):
    data = np.random.default_rng(size).integers(97, 122, size).astype(np.uint8)
    want = plain_counts(data.tolist())
    assert fp.counts(data).tolist() == want
    monkeypatch.setattr(fp, "STEP_BYTES", 64)
    assert fp.counts(data).tolist() == want


def test_digest_and_score():
    dice = random.Random(2)
    text = " ".join(dice.choice(["the", "cat", "sat", "on", "mats", "and", "rugs"]) for _ in range(400)).encode()
    one, other = fp.digest(text), fp.digest(bytes(range(256)) * 9)
    assert fp.likeness(one, one) == 1.0
    assert fp.likeness(one, other) == fp.likeness(other, one) < 0.5
    assert 0 <= fp.likeness(one, fp.digest(b"")) <= 1
    assert (fp.digest_of(fp.text_of(one)) == one).all()
    assert len(fp.text_of(one)) == 2 + fp.BUCKETS // 2
    assert fp.likeness(one, fp.digest(text + b" and one word more")) > 0.8


def plain(rows):
    ordered = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] is not None, (r[1] or "").encode()))
    out = []
    for at, (i, text) in enumerate(ordered):
        text, other = text or "", ordered[(at + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = (text[: len(text) - half] + other[:half]).encode()
        a, b, c = fp.digest(text.encode()), fp.digest(edited), fp.digest(other.encode())
        sha = hashlib.sha256(edited).hexdigest()
        out.append((i, len(text), sha, fp.text_of(a), fp.text_of(b), fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=str)


def got(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SHAPE)
    return sorted([tuple(r) for r in fp.with_next(docs, fp._compared, fp._COMPARED).collect()], key=str)


@pytest.mark.parametrize("size", [3, 50, 4096])
def test_next_document(spark, monkeypatch, size):
    monkeypatch.setattr(fp, "RANGE_ROWS", size)
    dice = random.Random(size)
    rows = [(dice.randrange(-50, 10**12), "é" * dice.randint(0, 9) + f"text {n}") for n in range(150)]
    rows += [(None, "none"), (None, None), (7, ""), (7, None), (7, "seven"), (7, "seven"), (8, "long " * 30_000)]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, "only this")], [(None, None)], [(5, "a b"), (5, "a b")]])
def test_few_rows(spark, rows):
    assert got(spark, rows) == plain(rows)


def test_fingerprinted_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "abc def", "x", 1), (None, None, "y", 2)], SHAPE)
    found = fp.fingerprinted(docs, name="digest").collect()
    assert [r.digest for r in found] == [fp.text_of(fp.digest(b"abc def")), fp.text_of(fp.digest(b""))]
    assert found[0].key == "x"


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = sorted([tuple(r) for r in fp.query(spark, folder).collect()], key=str)
    assert found == plain(docs)
    closer = [r[5] > r[6] for r in found if r[1] > 200]
    assert np.mean(closer) > 0.95
