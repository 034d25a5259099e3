import datetime as dt

from pyspark.sql import functions as F

from talkweave.operators.stats import conversation_by_period, conversation_totals
from talkweave.streaming.totals import ROCKS, STORE, read_by_day, read_totals, stream_totals, summarise_batch

SCHEMA = "conversation_id string, message_id long, sent_at timestamp_ntz, direction string, text string"
START = dt.datetime(2024, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


PARTS = [
    [("a", i, at(i), "from_me" if i % 3 else "to_me", "x") for i in range(60)] + [("a", 1, at(1), "from_me", "x")] * 3,
    [("b", i, at(i), "from_me" if i % 3 else "to_me", "again") for i in range(0, 60, 5)],  # known messages, a new conversation
    [("a", 100, at(-5), "to_me", "late"), ("c", 101, at(500), None, "no direction"), (None, 102, at(7), "to_me", "")],
    [],
]


def streamed(spark, tmp_path):
    folder, sink, rows = str(tmp_path / "in"), str(tmp_path / "sums"), []
    for part in PARTS:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(folder)
        query = stream_totals(spark.readStream.schema(SCHEMA).parquet(folder), sink, str(tmp_path / "check"))
        query.awaitTermination()
        done = [p for p in query.recentProgress if p["numInputRows"]]
        rows.append((sum(p["numInputRows"] for p in done), [s for p in done[-1:] for s in p["stateOperators"]]))
    return folder, sink, rows


def test_totals_by_batch(spark, tmp_path):
    before = spark.conf.get(STORE, None)
    folder, sink, rows = streamed(spark, tmp_path)
    assert spark.conf.get(STORE, None) == before != ROCKS
    # A batch reads its own rows only; the state holds the keys of all.
    assert [n for n, _ in rows] == [len(p) for p in PARTS]
    assert rows[2][1][0]["numRowsTotal"] >= 2 * 62
    whole = spark.read.parquet(folder)
    named = whole.fillna({"conversation_id": "null"})  # the one-shot query has no conversation for null
    columns = ("messages", "from_me", "to_me", "first_message_at", "last_message_at", "conversations")
    assert read_totals(spark, sink).select(*columns).collect() == conversation_totals(named).select(*columns).collect()
    want = conversation_by_period(whole, "day").select("day", "messages", "from_me", "to_me")
    got = read_by_day(spark, sink).select("day", "messages", "from_me", "to_me")
    assert sorted(got.collect()) == sorted(want.collect())
    some = read_by_day(spark, sink, since="2024-01-02", until="2024-01-03").collect()
    assert [(r.day, r.messages) for r in some] == [("2024-01-02", 24)]


def test_a_repeated_batch_counts_once(spark, tmp_path):
    facts = spark.createDataFrame([("message", "1", 0, at(0)), ("to_me", "1", 0, at(0)), ("conversation", "a", 5, at(0))], "kind string, key string, salt int, sent_at timestamp_ntz")
    for _ in range(2):
        summarise_batch(facts, 0, str(tmp_path))
    summarise_batch(facts.where(F.lit(False)), 1, str(tmp_path))
    row = read_totals(spark, str(tmp_path)).first()
    assert (row.messages, row.from_me, row.to_me, row.conversations) == (1, 0, 1, 1)
