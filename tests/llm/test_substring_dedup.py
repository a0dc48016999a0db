"""Passage removal against a brute-force version."""

import hashlib
import random
import re

import pytest

from compatlake.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string, doc string, w1 int"


def brute(rows, width):
    """Kept words and the number removed of each (doc_id, text)."""
    least = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, words in split:
        for at in range(len(words) - width + 1):
            if i is not None:
                key = tuple(words[at : at + width])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for at in range(len(words) - width + 1):
            if i is not None and least[tuple(words[at : at + width])] < i:
                gone.update(range(at, at + width))
        kept = " ".join(w for at, w in enumerate(words) if at not in gone)
        out.append((i, len(words), len(gone), kept))
    return sorted(out, key=str)


def found(spark, rows, width):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SHAPE)
    got = substring_dedup.repeated_passages(df, width).collect()
    return sorted(
        [
            (r.doc, r.n_words, sum(b - a for a, b in zip(r.remove_from, r.remove_to)), r.kept_text)
            for r in got
        ],
        key=str,
    )


def corpus(seed):
    dice = random.Random(seed)
    words = [f"w{n}" for n in range(40)] + ["é", " x", "日本"]
    shared = [" ".join(dice.choice(words) for _ in range(dice.randint(6, 30))) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(dice.choice(words) for _ in range(dice.randint(0, 15))) for _ in range(3)]
        if dice.random() < 0.6:
            parts.insert(dice.randrange(3), dice.choice(shared).replace(" ", dice.choice([" ", "\t", "\n \x0b"])))
        rows.append((i * 3 - 20, dice.choice([" ", "\n", "  "]).join(parts)))
    rows += [(5, rows[10][1]), (rows[3][0], rows[3][1]), (rows[3][0], rows[20][1]), (None, rows[20][1])]
    return rows + [(900, None), (901, ""), (902, " \t\n "), (903, "w1 " * 3000), (904, "w1 " * 200)]


@pytest.mark.parametrize("width", [1, 5, 8])
def test_against_brute_force(spark, width):
    rows = corpus(width)
    assert found(spark, rows, width) == brute(rows, width)


def test_words_made_to_share_a_polynomial(spark):
    """A Thue-Morse word and its complement agree in every polynomial hash modulo 2**64."""
    bits = [bin(n).count("1") & 1 for n in range(1 << 12)]
    one, two = ("".join("ab"[bit ^ flip] for bit in bits) for flip in (0, 1))
    rest = " ".join(f"w{n}" for n in range(49))
    rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}"), (4, f"{one[:1024]} {rest}"), (5, f"{two[:1024]} {rest}")]
    assert found(spark, rows, 50) == brute(rows, 50)


def test_empty_table(spark):
    assert found(spark, [], 50) == []


def test_intervals_are_maximal(spark):
    text = " ".join(f"a{n}" for n in range(30))
    rows = [(1, text), (2, "x " + text + " y " + text)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SHAPE)
    last = substring_dedup.repeated_passages(df, 10).where("doc = 2").first()
    assert (list(last.remove_from), list(last.remove_to)) == ([1, 32], [31, 62])


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(texts, 50)}
    got = substring_dedup.query(spark, folder).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert sum(r.n_removed for r in got) > 0
