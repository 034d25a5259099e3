import datetime as dt
import random

import plain
import pytest
from pyspark.sql import functions as F

from talkweave.operators.segment import build_exchange_windows, build_passages, build_turns

SCHEMA = (
    "conversation_id string, message_id long, sent_at timestamp_ntz, direction string, "
    "speaker string, text string"
)
T0 = dt.datetime(2024, 1, 1)


def frame(spark, conversations):
    rows = [
        (c, mid, None if at is None else T0 + dt.timedelta(seconds=at),
         "from_me" if who == "me" else "to_me", None if who == "me" else who, text)
        for c, messages in conversations.items()
        for mid, at, who, text in messages
    ]
    return spark.createDataFrame(rows, SCHEMA)


def got_turns(df):
    out = {}
    for r in df.orderBy("conversation_id", "start_message_id").collect():
        out.setdefault(r.conversation_id, []).append(
            (r.start_message_id, r.end_message_id, r.message_count, r.speaker, r.text)
        )
    return out


def want_turns(conversations, **kw):
    return {
        c: [(t["first"], t["last"], t["n"], t["speaker"], t["text"]) for t in found]
        for c, m in conversations.items()
        if (found := plain.turns(sorted(m), **kw))
    }


def random_talk(seed, n, speakers=("me", "ann"), monologue=False, longest=700):
    rng = random.Random(seed)
    messages, at, mid = [], 0, 0
    for _ in range(n):
        mid += rng.choice([1, 1, 1, 2, 9, 40])
        at += rng.choice([1, 5, 30]) if monologue else rng.choice([1, 60, 119, 120, 121, 500, -3])
        who = "ann" if monologue and rng.random() > 0.003 else rng.choice(speakers)
        text = rng.choice(["", "hi", "x" * rng.randint(1, longest), "y" * rng.randint(1, 40)])
        if rng.random() < 0.01:
            text = "z" * rng.randint(1990, 2500)
        messages.append((mid, None if rng.random() < 0.01 else at, who, text))
    return messages


def test_turn_borders(spark):
    convs = {
        "gap": [(1, 0, "me", "a"), (2, 120, "me", "b"), (3, 241, "me", "c"), (4, 240, "me", "d")],
        "blank": [(1, 0, "ann", "a"), (2, 10, "ann", "  "), (3, 20, "ann", "b")],
        "count": [(i, i, "me", "m") for i in range(1, 43)],
        "fits": [(1, 0, "me", "x" * 1500), (2, 1, "me", "y" * 499)],
        "over": [(1, 0, "me", "x" * 1500), (2, 1, "me", "y" * 500)],
        "cut": [(1, 0, "me", "x" * 2500), (2, 1, "me", "y")],
        "who": [(1, 0, "ann", "a"), (2, 1, "bob", "b"), (3, 2, "me", "c"), (4, 3, "ann", "d")],
    }
    clean = {c: [(i, t, s, x.strip()) for i, t, s, x in m] for c, m in convs.items()}
    assert got_turns(build_turns(frame(spark, convs))) == want_turns(clean)


@pytest.mark.parametrize("bits,piece", [(20, 1024), (3, 1024), (4, 32), (2, 64)])
def test_turns_match_loop(spark, bits, piece):
    convs = {
        "talk": random_talk(1, 600),
        "talk2": random_talk(2, 200, ("me", "ann", "bob")),
        "mono": random_talk(3, 1500, monologue=True, longest=250),
        "bot": [(i * 3, i, "ann", "tick %d" % i) for i in range(1, 900)],
    }
    df = frame(spark, convs)
    got = got_turns(build_turns(df, bits=bits, piece_rows=piece))
    assert got == want_turns(convs)


def test_composed_pieces(spark, monkeypatch):
    from talkweave.operators import segment

    monkeypatch.setattr(segment, "FAN", 3)
    rng = random.Random(5)
    convs = {"bot": [(i, i, "ann", "w" * rng.randint(1, 400)) for i in range(1, 2500)]}
    got = got_turns(build_turns(frame(spark, convs), bits=6, piece_rows=32))
    assert got == want_turns(convs)


def test_turn_numbers_and_windows(spark):
    convs = {"a": random_talk(7, 700), "b": random_talk(8, 9), "c": [(1, 0, "me", "only")]}
    turns = build_turns(frame(spark, convs), bits=3)
    numbers = turns.groupBy("conversation_id").agg(
        F.count("*").alias("n"), F.countDistinct("turn_no").alias("d"), F.max("turn_no").alias("m")
    )
    assert all(r.n == r.d == r.m for r in numbers.collect())
    for block in (1, 64):
        got = {}
        for r in build_exchange_windows(turns, block=block).orderBy("start_message_id").collect():
            got.setdefault(r.conversation_id, []).append(
                (r.start_message_id, r.end_message_id, r.turn_count, r.text)
            )
        want = {c: plain.windows(plain.turns(m)) for c, m in convs.items()}
        assert got == {c: w for c, w in want.items() if w}


@pytest.mark.parametrize("bits", [20, 4])
def test_passages_match_loop(spark, bits):
    lengths = [1, 2, 6, 7, 8, 9, 511, 512, 513, 1030]
    convs = {f"n{n}": [(i * 3, i, "me", "t%d" % i) for i in range(n)] for n in lengths}
    convs["blank"] = [(i, i, "ann", "" if i % 3 else "word") for i in range(20)]
    got = {}
    for r in build_passages(frame(spark, convs), bits=bits).orderBy("start_message_id").collect():
        got.setdefault(r.conversation_id, []).append(
            (r.start_message_id, r.end_message_id, r.message_count)
        )
    assert got == {c: plain.passages([m[0] for m in sorted(ms)]) for c, ms in convs.items()}


def test_passage_text(spark):
    convs = {"p": [(1, 0, "me", " hi "), (2, 1, "ann", ""), (3, None, "ann", "yo")]}
    row = build_passages(frame(spark, convs)).collect()[0]
    assert row.text == "2024-01-01T00:00:00.000Z · You: hi\nUnknown date · Contact: yo"
    assert row.directions == ["from_me", "to_me"] and row.message_count == 3
