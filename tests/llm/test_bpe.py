"""Byte-pair encoding against the tokenizers library."""

import hashlib
import random
from itertools import accumulate

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from compatlake.llm import bpe

PATH = bpe.default_path()
REFERENCE = Tokenizer.from_file(PATH)
SHAPE = "doc_id long, text string, ids string, decoded int"


def reference(text):
    ids = REFERENCE.encode(text or "", add_special_tokens=False).ids
    return ids, REFERENCE.decode(ids, skip_special_tokens=False)


def same(*texts):
    """One word after the other, and all words together."""
    words = bpe.vocabulary(PATH)
    data = [text.encode() for text in texts]
    ids, counts = words.encode_all(b"".join(data), [0, *accumulate(map(len, data))])
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == words.encode(text)
        assert (own.tolist(), words.decode(own.tolist())) == reference(text), text


@pytest.mark.parametrize(
    "text",
    [
        "",
        " ",
        "Hello, World's don't I'll we've 'SS",
        "<|endoftext|>a<|startoftext|> <|EndOfText|> <| x",
        "ΑΣ Σ ΟΔΟΣ İstanbul ẞ ǅ",
        "e\u0301te\u0301 \ufb01 A\u030a \u212b",
        "12 ²Ⅷ ½ ٣ 日本語テキスト 한국어",
        "a\u2028b\u3000c\x1cd\x85e\u200bf\ufeffg\u00a0h",
        "!!!???...,,, :-) 🎉👩‍👩‍👧",
        "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
        "x" * 5000 + "ab" * 3000,
        "thththththhehehe" * 500,
    ],
)
def test_texts(text):
    same(text)


def test_random_words():
    dice = random.Random(3)
    syllables = ["th", "e", "an", "in", "er", "re", "on", "a", "at", "ed", "é", "ou", "ß", "n", "s", "ing", "l", "ll", "o"]
    same(*("".join(dice.choice(syllables) for _ in range(dice.randint(1, 14))) for _ in range(3000)))
    for letters in ("ab", "aeinorst", "abcdefghijklmnopqrstuvwxyz", "lo", "a \ue000b<|", "xé\u0301. "):
        same(*("".join(dice.choice(letters) for _ in range(dice.randint(0, 60))) for _ in range(1500)))


def test_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    words = bpe.Vocabulary(PATH)
    for turn in range(30):
        text = " ".join(f"word{turn * k}" for k in range(turn)) + " the the"
        assert words.encode_all(text.encode(), [0, len(text)])[0].tolist() == reference(text)[0]


def test_clashing_names_and_odd_ids(spark):
    docs = spark.createDataFrame([("a b", "x", "y")], "text string, ids string, decoded string")
    found = bpe.decode(bpe.encode(docs, PATH), PATH, "_ids")
    assert found.columns == ["text", "ids", "decoded", "_ids", "_decoded"]
    assert tuple(found.first()) == ("a b", "x", "y", *reference("a b"))
    lists = spark.createDataFrame([(None,), ([],), ([-1, 10**8, None, 320],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(lists, PATH).collect()] == ["", "", bpe.vocabulary(PATH).text[320]]


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs", "Cn")), max_size=60))
def test_any_text(text):
    same(text)


def test_long_word_is_linear():
    words = bpe.vocabulary(PATH)
    assert len(words.encode("ha" * 500_000)) > 0


def test_frames(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "The cat", "x", 1), (None, "The cat", "x", 1), (5, "é" * 20_000, "x", 1)]
    docs = spark.createDataFrame(rows, SHAPE)
    found = bpe.decode(bpe.encode(docs, PATH, name="own"), PATH, "own", "back").collect()
    assert [(r.own, r.back) for r in found] == [reference(t) for _, t, _, _ in rows]
    assert bpe.encode(docs.limit(0), PATH, name="own").collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = bpe.query(spark, folder).collect()
    assert len(got) == len(docs)
    for row in got:
        ids, text = reference(docs[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
