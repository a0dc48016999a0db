"""Language identification against a plain version, and its accuracy on the held-out fold."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from compatlake.llm import language_id

SHAPE = "doc_id long, text string, lang string, score string, lang_pred int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, "x", 1) for i, t, la in rows], SHAPE)


def rows():
    found = []
    for n in range(120):
        found.append((n, f"The cat {n} sat with the other cats by the thing", "en"))
        found.append((200 + n, f"Der Hund {n} saß über den schönen Häusern", "de"))
        found.append((400 + n, f"Как дела {n} сегодня утром", "ru"))
    return [*found, (900, None, "en"), (901, "", "de"), (902, "12 34 !?", "en"), (None, "the cats", None)]


def plain(rows, text):
    """Naive Bayes with a dictionary of n-grams, hashed as the module does."""
    counts, totals = defaultdict(Counter), Counter()
    for i, t, lang in rows:
        if i is not None and t is not None and zlib.crc32(str(i).encode()) % 5:
            found, _, _ = language_id.grams([t], language_id.BUCKETS)
            counts[lang].update(found.tolist())
            totals[lang] += 1
    found, _, has = language_id.grams([text], language_id.BUCKETS)
    if not has[0]:
        return "und", 0.0
    sums = {}
    for lang, seen in counts.items():
        whole = sum(seen.values()) + language_id.SMOOTHING * language_id.BUCKETS
        sums[lang] = math.log(totals[lang] / totals.total())
        sums[lang] += sum(math.log((seen[g] + language_id.SMOOTHING) / whole) for g in found.tolist())
    best = max(sorted(sums), key=sums.get)
    return best, 1 / sum(math.exp(v - sums[best]) for v in sums.values())


def test_against_plain(spark):
    docs = rows()
    got = language_id.predict(frame(spark, docs), language_id.train(frame(spark, docs)), names=("lp", "sc")).collect()
    for row in got:
        lang, score = plain(docs, row.text or "")
        assert row.lp == lang
        assert row.sc == pytest.approx(score, abs=1e-3)
    assert len(got) == len(docs)


def test_grams_stay_in_their_text():
    one, owners, _ = language_id.grams(["ab", "", "c", "d" * 5000], 1 << 15)
    for n, text in enumerate(["ab", "", "c", "d" * 5000]):
        alone, _, has = language_id.grams([text], 1 << 15)
        assert sorted(one[owners == n]) == sorted(alone)
        assert has[0] == bool(text)


def test_nothing_learned(spark):
    docs = [(1, "abc", None), (2, None, "en")]
    got = language_id.predict(frame(spark, docs), language_id.train(frame(spark, docs)), names=("lp", "sc")).collect()
    assert [(r.lp, r.sc) for r in got] == [("und", 0.0)] * 2
    assert language_id.identified(frame(spark, [])).collect() == []


def test_bound_on_languages(spark):
    docs = [(n, "abc", f"l{n}") for n in range(1, 40)]
    with pytest.raises(ValueError, match="bounded"):
        language_id.train(frame(spark, docs), most=5)


def test_identified_keeps_columns(spark):
    kept = language_id.identified(frame(spark, rows()))
    assert kept.columns == ["doc_id", "text", "lang", "score", "lang_pred"]
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows()} - {900, 901, 902}


def test_identified_without_labels(spark):
    unlabelled = [(n, t, None) for n, t, _ in rows()]
    held_out = [(n, t, la if n is None or zlib.crc32(str(n).encode()) % 5 == 0 else None) for n, t, la in rows()]
    named_unknown = [(n, t, "und") for n, t, _ in rows()]
    for docs in (unlabelled, held_out, named_unknown):
        kept = language_id.identified(frame(spark, docs)).collect()
        assert sorted(str(r.doc_id) for r in kept) == sorted(str(n) for n, t, _ in docs if n not in (900, 901, 902))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = [r for r in language_id.query(spark, folder).collect()]
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_held_out_labels_do_not_count(spark):
    """The bound looks at what is learned from alone."""
    held = [(n, "abc", f"l{n}") for n in range(200) if zlib.crc32(str(n).encode()) % 5 == 0]
    known = [(n, "abc", "en") for n in range(200) if zlib.crc32(str(n).encode()) % 5]
    assert len(held) > 5
    assert language_id.train(frame(spark, held + known), most=5) is not None


def test_clashing_names(spark):
    docs = frame(spark, rows())
    assert {"score", "lang_pred"} <= set(docs.columns)
    found = language_id.predict(docs, language_id.train(docs))
    assert found.columns == [*docs.columns, "_lang_pred", "_score"] and found.select("score", "_score").count() == len(rows())
