"""The stored index against search without one."""

import os
import random

import pytest
from pyspark.sql import functions as F

from compatlake.operators import index, search
from compatlake.operators.versions import Versions

WORDS = ["a", "b", "c", "d", "e", "hot", "x1", "y-z", "z y"]
QUERIES = [("q1", "hot"), ("q2", "hot a"), ("q3", "y-z"), ("q4", "a b c"), ("q5", "y-z hot hot"), ("q6", "zzz"), ("q7", "a-b c"), ("q8", " - ")]


def tokens():
    return search.tokens(F.col("text"))



@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 16)


def text(dice):
    return " ".join(["hot"] * dice.randint(1, 3) + [dice.choice(WORDS) for _ in range(dice.randint(0, 8))])


def frame(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")


def same(spark, found, docs, limit=10):
    queries = spark.createDataFrame(QUERIES, "query_id string, query string")
    columns = ["query_id", "doc_id", "score", "rank"]
    got = found.search(queries, limit).select(columns).collect()
    want = search.search(frame(spark, docs), tokens(), queries, limit).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_build_change_merge_and_expire(spark, tmp_path, monkeypatch):
    dice = random.Random(1)
    docs = {n: text(dice) for n in range(300)}
    found = index.SearchIndex(spark, str(tmp_path))
    found.build(frame(spark, docs), tokens())
    same(spark, found, docs)
    before = {(r.token, r.block) for r in found._blocks(found.versions.latest()[1]).collect()}

    changed = {n: text(dice) + " fresh" for n in (3, 7, 290, 400, 401)}
    removed = [5, 6, 999]
    old = {n: docs.get(n, "") for n in [*changed, *removed]}
    docs.update(changed)
    docs = {n: t for n, t in docs.items() if n not in removed}
    found.update(frame(spark, changed), tokens(), spark.createDataFrame([(n,) for n in removed], "doc_id long"))
    same(spark, found, docs)
    # only blocks of their old and new words are written
    state = found.versions.latest()[1]
    written = spark.read.parquet(f"{tmp_path}/blocks-{state['parts'][1]}").select("token", "block").collect()
    words = {w for t in [*old.values(), *changed.values()] for w in t.replace("-", " ").split()}
    numbers = {r.doc_id: r.number for r in found.documents().collect()}
    touched = {n // 16 for n in [3, 7, 290, 5, 6]} | {numbers[400] // 16}
    assert {r.token for r in written} <= words and {r.block for r in written} <= touched
    assert len(written) < len(before) / 2
    assert state["documents"] == len(docs) and state["words"] == sum(len(t.replace("-", " ").split()) for t in docs.values())

    monkeypatch.setattr(index, "MOST_PARTS", 2)
    found.update(frame(spark, {3: "y z merged"}), tokens())
    docs[3] = "y z merged"
    assert len(found.versions.latest()[1]["parts"]) == 1
    same(spark, found, docs)
    found.expire()
    assert len([name for name in os.listdir(tmp_path) if name.startswith("blocks-")]) == 1
    same(spark, found, docs)


def test_common_word_reads_few_blocks(spark, tmp_path):
    """The word is in all documents; only blocks that could hold one of the best are read."""
    docs = {n: "hot" + " x" * (3 if n // 16 == 9 else 30 + n % 40) for n in range(800)}
    found = index.SearchIndex(spark, str(tmp_path))
    found.build(frame(spark, docs), tokens())
    read = []
    plain = index.top_rows

    def watched(rows, *rest):
        if "score" in rows.columns:
            read.append(rows.count())
        return plain(rows, *rest)

    index.top_rows = watched
    try:
        hits = found.search(spark.createDataFrame([("q", "hot")], "query_id string, query string"), 5).collect()
    finally:
        index.top_rows = plain
    assert [r.doc_id for r in sorted(hits, key=lambda r: r.rank)] == [144, 145, 146, 147, 148]
    assert read[0] <= index.FIRST * 16 and read[1] < 100


def test_empty_index_and_text(spark, tmp_path):
    found = index.SearchIndex(spark, str(tmp_path))
    found.build(spark.createDataFrame([], "doc_id long, text string"), tokens())
    queries = spark.createDataFrame(QUERIES, "query_id string, query string")
    assert found.search(queries).collect() == []
    found.update(frame(spark, {1: None, 2: "", 3: "hot a"}), tokens())
    assert [(r.query_id, r.doc_id) for r in found.search(queries).orderBy("query_id").collect()] == [("q1", 3), ("q2", 3)]


def test_two_writers(spark, tmp_path):
    one, two = (index.SearchIndex(spark, str(tmp_path)) for _ in range(2))
    one.build(frame(spark, {1: "a"}), tokens())
    stale = two.versions.latest()
    one.update(frame(spark, {2: "b"}), tokens())
    two.versions.latest = lambda: stale if not raised else Versions.latest(two.versions)  # what it saw when it started
    raised = []
    plain = two.versions.publish
    two.versions.publish = lambda *a: plain(*a) or raised.append(1) or False
    with pytest.raises(index.ChangedMeanwhile):
        two.update(frame(spark, {3: "c"}), tokens())
    assert {r.doc_id for r in one.documents().collect()} == {1, 2}
    assert len([name for name in os.listdir(tmp_path) if name.startswith("blocks-")]) == 2


def test_versions_are_taken_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda n: Versions(spark, str(tmp_path)).publish(1, {"writer": n}), range(8)))
    assert sum(won) == 1 and Versions(spark, str(tmp_path)).latest() == (1, {"writer": won.index(True)})
