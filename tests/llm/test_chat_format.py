"""Chat formatting against a brute-force version."""

import random
from collections import defaultdict

import checkall
import pytest

from compatlake.llm import chat_format, queries

SHAPE = "conv_id long, turn long, role string, text string, place int, h1 string"


def brute(rows):
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            held[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    chats = {c: tuple((r.decode(), t.decode()) for _, _, r, t in sorted(turns)) for c, turns in held.items()}
    prefixes = {turns[:n] for turns in chats.values() for n in range(len(turns))}
    out = []
    for turns in set(chats.values()) - prefixes:
        equal = [c for c, own in chats.items() if own == turns]
        text, spans = "", []
        for role, said in turns:
            text += f"<|im_start|>{role}\n"
            if role == "assistant":
                spans.append(f"{len(text)}:{len(text) + len(said)}")
            text += f"{said}<|im_end|>\n"
        out.append((min(equal), len(turns), len(equal), text, ",".join(spans)))
    return sorted(out)


def rows():
    dice = random.Random(8)
    said = ["hi", "", None, "é", "what?", "long " * 3000, "{role}"]
    out = []
    for conv in range(60):
        turns = [(dice.choice(["user", "assistant", "system", None]), dice.choice(said)) for _ in range(dice.randint(1, 5))]
        for n in range(1, len(turns) + 1):
            if dice.random() < 0.5 or n == len(turns):
                out += [(conv * 10 + n, t, *turn) for t, turn in enumerate(turns[:n])]
    out += [(None, 0, "user", "lost"), (901, None, "user", "b"), (901, None, "user", "a"), (901, 1, "user", "a"), (901, 1, "user", "a")]
    out += [(950, 5, "user", "only"), (951, 0, "user", "only"), (952, 0, "user", "only"), (952, 1, "assistant", "more")]
    dice.shuffle(out)
    return out


@pytest.mark.parametrize("count", [0, 10_000])
def test_against_brute_force(spark, count):
    docs = rows()[:count]
    frame = spark.createDataFrame([(*r, 1, "x") for r in docs], SHAPE)
    got = sorted([tuple(r) for r in chat_format.format_chats(frame).collect()])
    assert got == brute(docs)
    assert bool(got) == bool(count)


def test_template(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a", 1, "x"), (1, 1, "bot", "b", 1, "x")], SHAPE)
    template = chat_format.Template("[{role}] ", "\n", ("bot",))
    row = chat_format.format_chats(frame, template).first()
    assert (row.rendered, row.trained_spans) == ("[user] a\n[bot] b\n", "15:16")


def test_maximal(spark):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows()], SHAPE)
    assert sorted(r.conv_id for r in chat_format.maximal(frame).collect()) == [r[0] for r in brute(rows())]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    good, what = checkall.compare(spark, checkall.database(folder), folder, name)
    assert good, what
