"""Conversation repair against trying every edit."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from compatlake.llm import conversation_repair as cr

SHAPE = "conv_id long, turn long, role string, text string, conv string, place int"
FOLDER = "/root/testdata/sf0.001"


def plain_repair(rows):
    """(cost, audit, repaired rows) of rows (role, text, fault)."""

    @functools.cache
    def best(at, state, added):
        found = []
        if at == len(rows) and state in (0, 3):
            found.append((0, "", ()))
        wanted, onward = ("assistant", 3) if state == 2 else ("user", 2)
        if added < 3:
            cost, audit, lines = best(at, onward, added + 1)
            found.append((cost + 5, "I" + audit, ((wanted, ""), *lines)))
        if at < len(rows):
            role, text, fault = rows[at]
            cost, audit, lines = best(at + 1, state, 0)
            found.append((cost + 2, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                cost, audit, lines = best(at + 1, onward, 0)
                found.append((cost + 1 + more, "R" + audit, ((wanted, text), *lines)))
                if role[:1] == wanted[0]:
                    found.append((cost + more, "K" + audit, ((role, text), *lines)))
                if role[:1] == "s" and state == 0:
                    cost, audit, lines = best(at + 1, 1, 0)
                    found.append((cost + more, "K" + audit, ((role, text), *lines)))
        return min(found, key=lambda option: option[:2], default=(10**9, "", ()))

    return best(0, 0, 0)


def bare(text):
    return text.rstrip(" \t\n\x0b\x0c\r")


def plain_rows(rows):
    """All columns of a conversation's damaged rows (turn, role, text), in order."""
    seen, judged = set(), []
    for _, role, text in rows:
        fault = "none"
        if not bare(text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif bare(text)[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        judged.append((role, text, fault))
    turns = [turn for turn, _, _ in rows if turn is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults = [fault for _, _, fault in judged]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = plain_repair(tuple(judged))
    text = "\n".join(f"{role}:{text}" for role, text in lines)
    counts = tuple(faults.count(name) for name in ("blank", "duplicate", "truncated"))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def digest_order(row):
    turn, role, text = row
    digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    return (turn is not None, turn or 0, role, digest)


def expected(rows):
    """By conversation, from rows (conv, turn, role, text)."""
    found = {}
    for conv, turn, role, text in rows:
        own = found.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        own.append((turn, role, text))
    return {conv: plain_rows(sorted(own, key=digest_order)) for conv, own in found.items()}


def results(pieces, figures):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    rows = {r.conv: tuple(r[n] for n in names) for r in figures.collect()}
    digests = {r.conv: (r.audit, r.repaired_sha256) for r in cr.digests(pieces).collect()}
    assert set(rows) == set(digests)
    return {conv: rows[conv] + digests[conv] for conv in rows}


def test_runs_by_powers():
    dice = random.Random(4)
    for _ in range(1500):
        symbols = bytes(s for _ in range(dice.randint(0, 6)) for s in [dice.randrange(16)] * dice.choice([1, 1, 2, 3, 5]))
        rows = tuple(("suax"[s >> 2], str(i), cr.FAULTS[s & 3]) for i, s in enumerate(symbols))
        cost, audit, _ = plain_repair(rows)
        letters, state = cr.unroll(symbols, cr.END, 0)
        assert ("".join(letters) + cr.ending(state), cr.whole_cost(symbols)) == (audit, cost), symbols
        cut = dice.randint(0, len(symbols))
        assert cr.times(cr.product(symbols[:cut]), cr.product(symbols[cut:])) == cr.product(symbols)


@pytest.fixture
def many_chunks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def random_rows(seed):
    dice = random.Random(seed)
    texts = ["", " \n", "Yes.", "No!", "cut", "Why?  ", "Sure. ", "and", None]
    roles = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", None, "", "u", "super"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(dice.randint(1, 9)):
            where = dice.choice([turn, turn, turn, turn * 2, None])
            rows += [(conv, where, dice.choice(roles), dice.choice(texts), "x", 1)] * dice.choice([1, 1, 1, 2])
    for turn in range(150):  # a conversation over several chunks
        role = dice.choice(["user", "assistant", "assistant", "tool"]) if turn % 7 == 0 else ["user", "assistant"][turn % 2]
        rows.append((777, turn * 2, role, f"{turn}." if turn % 5 else "Again.", "x", 1))
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, many_chunks, seed, monkeypatch):
    monkeypatch.setattr(cr, "PIECE_ROWS", 5 if seed == 1 else 4096)
    rows = random_rows(seed)
    pieces, figures = cr.repair(spark.createDataFrame(rows, SHAPE).repartition(3))
    assert results(pieces, figures) == expected([row[:4] for row in rows])
    assert pieces.where("conv = 777").count() > 2


def test_hot_rows_and_long_texts(spark, many_chunks):
    rows = [(1, 5, "user", "Same text.", "x", 1)] * 3000 + [(2, None, "user", "ab " * 700_000, "x", 1), (2, 3, "assistant", "é." * 900_000, "x", 1)]
    got = results(*cr.repair(spark.createDataFrame(rows, SHAPE)))
    assert got[1][:6] == (0, 0, 2999, 0, 2999, 2 * 2999 + 2) and got[1][6] == "D" * 3000
    assert got[2] == expected([r[:4] for r in rows[3000:]])[2]


def test_empty(spark):
    pieces, figures = cr.repair(spark.createDataFrame([], SHAPE))
    assert results(pieces, figures) == {}


def plain_damage(rows):
    found = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        found += [(conv, turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return found


def test_damage(spark):
    rows = [row[:4] for row in random_rows(3)]
    got = cr.damaged(spark.createDataFrame([(*row, "x", 1) for row in rows], SHAPE))
    plain = lambda rows: sorted(map(repr, rows))
    assert plain(tuple(r) for r in got.collect()) == plain(plain_damage(rows))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(plain_damage(rows))
    nothing = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    got = {r.conv_id: tuple(r)[1:] for r in cr.query(spark, FOLDER).collect()}
    assert got == {conv: want.get(conv, nothing) for conv, *_ in rows}
