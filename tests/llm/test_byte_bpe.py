"""Byte-level byte-pair encoding against the tiktoken library on uncut texts."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from compatlake.llm import byte_bpe

PATH, PATTERN = byte_bpe.default_vocabulary()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
REFERENCE = tiktoken.Encoding("reference", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
SHAPE = "doc_id long, text string, ids string, decoded int"


def plain_merge(match: bytes) -> list[int]:
    """Merges by rank, least first, leftmost of equals."""
    pieces = [match[i : i + 1] for i in range(len(match))]
    while True:
        ranked = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(pieces, pieces[1:])) if a + b in RANKS]
        if not ranked:
            return [RANKS[p] for p in pieces]
        _, at = min(ranked)
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]


def cut_ids(text, size):
    return [int(i) for part in byte_bpe.parts(text, size) for i in byte_bpe.ranks(PATH, PATTERN).encode(part)]


@pytest.mark.parametrize("text", ["", " ", "it's  the\n\n end", "ab12cd, ef", "日本語。テキスト、12", "don't'll 'S", "x　 y\x1c z\x85 "])
def test_cut_anywhere(text):
    assert "".join(byte_bpe.parts(text, 1)) == text
    for size in (1, 2, 3, 5):
        assert cut_ids(text, size) == REFERENCE.encode_ordinary(text)


@settings(max_examples=500, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'stlve.,19aZßжя日、。　\x1c\x85́"), st.characters(blacklist_categories=("Cs",))), max_size=80))
def test_any_text(text):
    assert cut_ids(text, 1) == cut_ids(text, 7) == REFERENCE.encode_ordinary(text)
    ids = np.array(cut_ids(text, 4), dtype=np.int64)
    assert byte_bpe.ranks(PATH, PATTERN).decode(ids, np.array([0, len(ids)])).to_pylist() == [text.encode()]


def test_plain_merges():
    dice = random.Random(5)
    for _ in range(500):
        match = "".join(dice.choice("theinßя日") for _ in range(dice.randint(1, 12)))
        assert cut_ids(match, 10**6) == plain_merge(match.encode())


def test_long_texts():
    for text in ("the cat sat. " * 40_000, "a" * 300_000, "日本語テキスト、" * 40_000, " " * 200_000 + "x", "<|endoftext|>" * 9000):
        assert byte_bpe.ranks(PATH, PATTERN).encode(text).tolist() == REFERENCE.encode_ordinary(text)
    assert max(map(len, byte_bpe.parts("the cat sat. " * 40_000))) < byte_bpe.PART + 20


@pytest.mark.parametrize("packed", [False, True])
def test_frames(spark, packed):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "The cat", "x", 1), (None, "The cat", "x", 1), (5, "é" * 20_000, "x", 1)]
    docs = spark.createDataFrame(rows, SHAPE)
    coded = byte_bpe.encode(docs, PATH, PATTERN, packed=packed)
    assert coded.columns == ["doc_id", "text", "ids", "decoded", "_ids"]
    found = byte_bpe.decode(coded, PATH, PATTERN, "_ids")
    assert found.columns[-1] == "_decoded"
    for row, (_, text, _, _) in zip(found.collect(), rows):
        ids = np.frombuffer(row._ids, dtype="<u4").tolist() if packed else row._ids
        assert ids == REFERENCE.encode_ordinary(text or "") and bytes(row._decoded) == (text or "").encode()
    assert byte_bpe.decode(coded.limit(0), PATH, PATTERN, "_ids").collect() == []


def test_odd_ids(spark):
    lists = spark.createDataFrame([(None,), ([],), ([-1, 10**9, None, RANKS[b"a"], 50256],)], "ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(lists, PATH, PATTERN).collect()] == [b"", b"", b"a"]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = byte_bpe.query(spark, folder).collect()
    assert len(got) == len(docs)
    for row in got:
        ids = REFERENCE.encode_ordinary(docs[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()
