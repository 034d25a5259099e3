import datetime as dt
import random

import pandas as pd
import pytest

from talkweave.operators.segment import build_turns
from talkweave.streaming.turns import TurnRules, stream_turns

SCHEMA = "conversation_id string, message_id long, sent_at timestamp_ntz, direction string, speaker string, text string"
START = dt.datetime(2024, 1, 1)


def messages(seed, n):
    rng, now, rows = random.Random(seed), START, []
    for id in range(n):
        now += dt.timedelta(seconds=rng.choice([0, 1, 20, 60, 200]))
        me = rng.random() < 0.3
        text = rng.choice(["hello", "a longer message", "é" * 60, " ", None, "see http://x.y/z"])
        rows.append((rng.choice("aab") , id, now, "from_me" if me else "to_me", None if me else rng.choice(["u", "v"]), text))
    return rows


def run(spark, tmp_path, parts, **rules):
    folder, sink, progress = str(tmp_path / "in"), str(tmp_path / "out"), []
    for part in parts:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(folder)
        query = stream_turns(spark.readStream.schema(SCHEMA).parquet(folder), sink, str(tmp_path / "check"), **rules)
        query.awaitTermination()
        progress += query.recentProgress
    return spark.read.parquet(sink), progress


def rows_of(df):
    columns = ("conversation_id", "start_message_id", "end_message_id", "start_at", "end_at", "direction", "speaker", "message_count", "text")
    return sorted(tuple(r) for r in df.select(*columns).collect())


END = ("end", 10**6, START + dt.timedelta(days=900), "to_me", "z", "the end")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_equal_to_the_turns_of_the_whole_table(spark, tmp_path):
    rows = messages(1, 400)
    # Every ninth message comes one batch late, inside the delay.
    parts = [[m for m in rows if min(2, m[1] // 150 + (m[1] % 9 == 0)) == n] for n in range(3)]
    rules = {"gap_seconds": 120, "max_messages": 4, "max_chars": 90}
    got, _ = run(spark, tmp_path, [*parts[:2], [*parts[2], END]], delay="3 hours", **rules)
    assert got.where("late").count() == 0
    want = build_turns(spark.createDataFrame(rows, SCHEMA), numbered=False, **rules)
    assert rows_of(got) == rows_of(want)


def test_turns_close_once_by_the_timer_and_late_messages_follow_the_rule(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    said = lambda id, s, text="x", who="a": (who, id, at(s), "to_me", "u", text)
    first = [said(1, 0), said(2, 30), ("a", 3, None, "to_me", "u", "no time"), said(50, 5000, who="b")]
    second = [said(4, 10, "too late"), said(5, 4990, "z"), said(51, 9000, who="b"), said(8, 8000, "new turn")]
    third = [said(7, 9100, "an old id"), said(52, 20000, who="b")]
    got, progress = run(spark, tmp_path, [first, second, third, [END]], delay="60 seconds")
    rows = sorted((r.conversation_id, r.start_message_id, r.end_message_id, r.text, r.late) for r in got.collect())
    assert rows == [
        ("a", 1, 2, "x\nx", False), ("a", 3, 3, "no time", True), ("a", 5, 5, "z", False), ("a", 7, 7, "an old id", True), ("a", 8, 8, "new turn", False),
        ("b", 50, 50, "x", False), ("b", 51, 51, "x", False), ("b", 52, 52, "x", False),
    ]
    dropped = sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])
    assert dropped == 1


class Held:
    """A state with the watermark of its time, in seconds."""

    exists, hasTimedOut, get, watermark = False, False, None, 0

    def getCurrentWatermarkMs(self):
        return self.watermark * 1000

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutTimestamp(self, at):
        pass


def test_a_call_that_closes_nothing_makes_no_frame():
    rules, state = TurnRules(120, 20, 2_000), Held()
    said = lambda *seconds: pd.DataFrame({
        "message_id": list(seconds), "tick": [s * 1_000_000 for s in seconds], "speaker": "u", "direction": "to_me", "said": "x"})
    assert list(rules(("a",), iter([said(10, 20)]), state)) == []
    state.watermark = 30
    assert list(rules(("a",), iter([said(1000)]), state)) == []
    state.watermark, state.hasTimedOut = 2000, True
    made = pd.concat(rules(("a",), iter([]), state))
    assert made[["start_message_id", "end_message_id", "end_tick", "message_count", "text"]].values.tolist() == [
        [10, 20, 20_000_000, 2, "x\nx"], [1000, 1000, 1_000_000_000, 1, "x"]]
