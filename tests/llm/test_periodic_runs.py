"""Periodic runs against trying every period at every place."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from compatlake.llm import periodic_runs as pr

SHAPE = "doc_id long, text string, runs string, doc int"


def smallest_period(words):
    border, at = [0] * (len(words) + 1), 0
    border[0] = -1
    at = -1
    for i, word in enumerate(words):
        while at >= 0 and words[at] != word:
            at = border[at]
        at += 1
        border[i + 1] = at
    return len(words) - border[len(words)]


def plain_runs(words, least=6, exponent=4):
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(least, exponent * q) and smallest_period(words[start : start + length]) == q:
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(dice):
    letters = dice.choice(["ab", "abc", "abcdefgh"])
    words = []
    for _ in range(dice.randint(0, 6)):
        piece = [dice.choice(letters) for _ in range(dice.randint(1, 7))]
        words += piece * dice.choice([1, 1, 2, 4, 5, 9])
        words = words + words[: dice.randint(0, len(words))] * dice.choice([0, 0, 1, 4])
    return words[:400]


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (1, 2), (10, 3), (6, 5)])
def test_random(least, exponent):
    dice = random.Random(least * 10 + exponent)
    for _ in range(600):
        words = random_words(dice)
        numbers = np.array([ord(w) for w in words], dtype=np.int64)
        assert pr.find_runs(numbers, least, exponent) == plain_runs(words, least, exponent), words


def test_suffixes_and_prefixes():
    dice = random.Random(1)
    for _ in range(200):
        words = random_words(dice)[:80]
        numbers = np.array([ord(w) for w in words], dtype=np.int64)
        if not words:
            continue
        order = pr.sorted_suffixes(numbers)
        assert order.tolist() == sorted(range(len(words)), key=lambda i: words[i:])
        want = [0]
        for a, b in zip(order[:-1], order[1:]):
            n = 0
            while max(a, b) + n < len(words) and words[a + n] == words[b + n]:
                n += 1
            want.append(n)
        assert pr.neighbour_prefixes(numbers, order).tolist() == want


def test_long_texts_are_not_quadratic():
    started = time.time()
    for words in (np.zeros(300_000, dtype=np.int64), np.arange(300_000) % 1000, np.tile(np.random.RandomState(1).randint(0, 9, 60_000), 5)):
        assert pr.find_runs(words.astype(np.int64))
    assert time.time() - started < 60


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = (None,) * 4
    for s, length, q in runs:
        if best[0] is None or length * best[2] > best[1] * q:
            best = (s, length, q, 1000 * length // q)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_frames(spark):
    texts = [None, "", " \n", "a a a a a", "a a a a a a", "x " + "b\tc " * 4 + "b", "é è " * 30_000, "tick tock " * 3 + "tick", "a\x1ca a a a a a"]
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)] + [(None, "a a a a a a a", "r", 1)] * 2
    found = pr.periodic_runs(spark.createDataFrame(rows, SHAPE)).collect()
    assert len(found) == len(rows)
    for row, (doc, text, _, _) in zip(found, rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want = plain_runs(words) if len(words) < 1000 else [(0, 60_000, 2)]
        assert (row.doc, row.n_words, [tuple(r) for r in row.runs]) == (doc, len(words), want)
        drop = {i for s, length, q in want for i in range(s + q, s + length)}
        assert row.kept_text == " ".join(w for i, w in enumerate(words) if i not in drop)
    assert pr.periodic_runs(spark.createDataFrame([], SHAPE)).collect() == []
    with pytest.raises(ValueError):
        pr.periodic_runs(spark.createDataFrame(rows, SHAPE), exponent=1)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: plain_row(r.doc_id, r.text) for r in docs if len(r.text.split()) < 3000}
    got = {r.doc_id: tuple(r)[:8] for r in pr.query(spark, folder).collect()}
    assert len(got) == len(docs) and sum(row[1] > 0 for row in want.values()) > 10
    assert {k: got[k] for k in want} == want
