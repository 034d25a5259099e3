import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.operators import agenda, threads, tone
from talkweave.operators.segment import build_exchange_windows, build_passages, build_turns
from talkweave.plans.tools import Toolbox
from talkweave.operators.search import store_token_index
from talkweave.sources import calendar as cal
from talkweave.sources.driver_tables import (
    address_books, archive, calendar_from_events, messages_from_conversations, messages_from_events,
)
from talkweave.sources.contacts import load_contacts
from talkweave.streaming import incremental as inc

KEY = b"k"
DAY = dt.datetime(2024, 3, 1)


def event(i, start, hours=1, **more):
    base = dict(source_id=f"e{i}", calendar_id="c", calendar="Work", title=f"Event {i}", is_all_day=False,
                location=None, notes=None, status="confirmed", availability="busy")
    stamp = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")
    at = DAY + dt.timedelta(hours=start)
    return {**base, "start_at": stamp(at), "end_at": stamp(at + dt.timedelta(hours=hours)), **more}


def snapshot(tmp_path, events, version=1, name="s.json"):
    body = {"format_version": version, "updated_at": "2024-03-01T00:00:00Z", "range_start": "2000-01-01T00:00:00Z",
            "range_end": "2029-01-01T00:00:00Z", "events": events}
    (tmp_path / name).write_text(json.dumps(body))
    return str(tmp_path / name)


def test_calendar(spark, tmp_path):
    events = [
        event(1, 0, notes="n" * 12_000), event(2, 5, title=None, location="Big ROOM", status=None, availability=None),
        event(3, 10, 20, calendar_id=None, calendar="Home"), event(4, 30), event(5, 40, start_at="soon"),
    ]
    rows = cal.load_calendar(spark, snapshot(tmp_path, events))
    search = lambda *a, **k: sorted(r.title for r in agenda.search_calendar_events(rows, KEY, *a, **k).collect())
    assert search(since="2024-03-01T20:00:00Z", until="2024-03-02T06:00:00Z") == ["Event 3"]  # crosses since, 4 starts at until
    assert search("room") == ["Untitled event"] and search("%") == []
    assert search(now=DAY + dt.timedelta(days=1)) == ["Event 3", "Event 4"]
    page = agenda.search_calendar_events(rows, KEY, "e", limit=2).collect()
    assert [(r.total_matches, r.returned) for r in page] == [(2, 2)] * 2 or len(page) == 2
    preview = {r.title: r.notes_preview for r in agenda.search_calendar_events(rows, KEY, "event").collect()}
    assert len(preview["Event 1"]) == 12_000
    cut = agenda.search_calendar_events(rows, KEY, "event", chars=280)
    assert cut.filter("title = 'Event 1' and length(notes_preview) = 280").count() == 1
    ids = [r.event_id for r in agenda.calendar_event_view(rows, KEY).filter("title = 'Event 1'").collect()]
    full = agenda.read_calendar_events(rows, KEY, [*ids, "event_x"]).collect()
    assert [(len(r.notes), r.requested, r.found) for r in full] == [(12_000, 2, 1)]
    second = agenda.calendar_event_view(rows, KEY).filter("title = 'Untitled event'").first()
    assert (second.status, second.availability) == ("none", "not_supported")
    info = agenda.calendar_info(rows, KEY).collect()
    assert [(r.name, r.event_count, r.total_events) for r in info] == [("Home", 1, 5), ("Work", 4, 5)]
    with pytest.raises(ValueError, match="after"):
        search(since="2024-03-02T00:00:00Z", until="2024-03-02T00:00:00Z")
    for bad in (0, 1001):
        with pytest.raises(ValueError, match="limit"):
            search(limit=bad)
    with pytest.raises(ValueError):
        agenda.read_calendar_events(rows, KEY, [])


def test_calendar_version(spark, tmp_path):
    for body in (snapshot(tmp_path, [event(1, 0)], version=2), snapshot(tmp_path, None, name="t.json")):
        with pytest.raises(Exception, match="snapshot is invalid"):
            cal.load_calendar(spark, body).select("title").collect()


def test_calendar_dedupe(spark):
    at = DAY
    rows = [(1, "c", "a", at, "old"), (2, "c", "a", at, " new "), (3, "c", "a", at + dt.timedelta(hours=1), ""), (4, "d", None, at, None)]
    df = spark.createDataFrame(rows, "read_order int, calendar_id string, identifier string, start_at timestamp_ntz, title string")
    got = [(r.source_id, r.title) for r in cal.dedupe_calendar(df).collect()]
    assert got == [("c|a|2024-03-01T00:00:00Z", "new"), ("d|event|2024-03-01T00:00:00Z", "Untitled event"), ("c|a|2024-03-01T01:00:00Z", "Untitled event")]


def test_threads(spark):
    rows = [
        ("a", 1, "user", "sending"), ("a", 2, "assistant", "delivered"), ("a", 3, "user", "sending"),
        ("b", 1, "user", "delivered"), ("b", 2, "user", None), ("c", 1, "assistant", "delivered"), ("c", 2, "user", "failed"),
    ]
    df = spark.createDataFrame([(t, i, r, f"m{i}", s, DAY) for t, i, r, s in rows],
                               "thread_id string, id long, role string, content string, delivery_status string, created_at timestamp_ntz")
    status = lambda d: {(r.thread_id, r.id): r.delivery_status for r in d.collect()}
    before = status(df)
    assert status(threads.reconcile_delivery(df)) == {**before, ("a", 1): "delivered", ("a", 3): "failed"}
    assert status(threads.flag_orphans(df)) == {**before, ("b", 1): "failed"}
    got = {r.thread_id: (r.preview, r.message_count) for r in threads.thread_summaries(df).collect()}
    assert got == {"a": ("m3", 3), "b": ("m2", 2), "c": ("m2", 2)}


def test_stale(spark):
    now = dt.datetime(2024, 3, 2)
    old, fresh = now - dt.timedelta(seconds=86_401), now - dt.timedelta(seconds=86_400)
    rows = [("idle", 4, "x", 100, fresh), ("idle", 3, "x", 100, fresh), ("idle", 4, None, 100, fresh), ("refreshing", 3, None, 0, None),
            ("idle", 4, "x", 0, fresh), ("idle", 4, "x", 99, old), ("idle", 4, "x", 99, fresh), ("idle", 4, "x", 100, old), ("idle", 4, "x", 99, None)]
    df = spark.createDataFrame(rows, "status string, format_version int, content string, source_message_count int, updated_at timestamp_ntz")
    got = [r.stale for r in threads.snapshot_is_stale(df.coalesce(1), 100, now).collect()]
    assert got == [False, True, True, False, False, True, False, False, True]
    got = [r.stale for r in threads.snapshot_is_stale(df.coalesce(1), 250, now).collect()]
    assert got[4] is True


def test_ordered_dedupe(spark):
    values = ["one question is here", "short", "one  question is here", "x" * 69] + [f"another question {i}" for i in range(4)]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)] + [("h", 0, "only one of them here")], "g string, o int, v string")
    got = {r.v for r in threads.ordered_dedupe(df, "g", "v", "o", k=3).filter("g = 'g'").collect()}
    assert got == {"one question is here", "another question 0", "another question 1"}
    with_defaults = threads.ordered_dedupe(df, "g", "v", "o", k=2, defaults=("d1", "d2", "d3")).collect()
    assert sorted(r.v for r in with_defaults if r.g == "h") == ["d1", "d2"]


def scored(spark, rows):
    names = "start_at timestamp_ntz, direction string, negative double, neutral double, positive double"
    df = spark.createDataFrame(rows, names)
    return df.withColumn("valence", F.col("positive") - F.col("negative")).withColumn("confidence", F.greatest("negative", "neutral", "positive"))


def test_tone(spark):
    d = lambda y, m: dt.datetime(y, m, 1)
    rows = scored(spark, [
        (d(2023, 3), "from_me", 0.5, 0.5, 0.0), (d(2023, 4), "to_me", 0.2, 0.4, 0.4), (d(2024, 1), "to_me", 0.1, 0.2, 0.7),
        (None, "to_me", 0.0, 0.0, 1.0), (d(2024, 1), "to_me", None, None, None)])
    total = tone.tone_summary(rows).first()
    assert (total["count"], total.negative_share, total.neutral_share, total.positive_share) == (4, 0.25, 0.25, 0.5)
    empty = tone.tone_summary(rows.filter("direction = 'x'")).first()
    assert (empty["count"], empty.negative, empty.positive_share) == (0, 0.0, 0.0)
    assert [r.period for r in tone.tone_timeline(rows, "quarter").collect()] == [None, "2023-Q1", "2023-Q2", "2024-Q1"]
    trend = [(r.series, r.period, r.partial) for r in tone.tone_trends(rows.filter("start_at is not null"), dt.date(2024, 3, 9)).collect()]
    assert trend == [("recent", "2023-04", False), ("recent", "2024-01", False), ("yearly", "2023", False), ("yearly", "2024", True)]
    cover = tone.tone_coverage(rows, rows.limit(0)).first()
    assert (cover.total, cover.analyzed, cover.coverage_percent) == (5, 4, 80.0)


def test_scorer_batches(spark):
    sizes = []

    def fn(texts):
        assert len(texts) <= 8
        return np.array([[0.0, float(len(t)), 0.0] for t in texts])

    df = spark.range(30).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    for r in tone.score_tone(df, fn, model_version="v1").collect():
        n = np.exp(r.id - max(r.id, 0))
        assert r.neutral == pytest.approx(n / (n + 2 * np.exp(-float(max(r.id, 0)))))
        assert r.model_version == "v1"
    assert sizes == []


# --- streams ----------------------------------------------------------------


@pytest.fixture()
def batches(spark, sf, tmp_path):
    messages = messages_from_events(spark, sf).select("conversation_id", "message_id", "sent_at", "direction", "text")
    parts = [messages.filter(F.col("message_id").between(i * 250, i * 250 + 249)).coalesce(1) for i in range(4)]
    # A late row, and a repeated one, must change nothing.
    parts[3] = parts[3].unionAll(messages.filter("message_id = 3")).unionAll(messages.filter("message_id = 800"))
    folder = str(tmp_path / "in")
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(folder)
    return messages, parts, folder


def by_id(df):
    return sorted(tuple(str(v) for v in r) for r in df.select("conversation_id", "start_message_id", "end_message_id", "text").collect())


def test_stream_equals_one_shot(spark, batches, tmp_path):
    messages, _, folder = batches
    sink = str(tmp_path / "sink")
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    inc.stream_rebuild(stream, sink, f"{sink}/checkpoint", build_passages).awaitTermination()
    stored = inc.read_messages(spark, sink)
    assert stored.count() == stored.select("conversation_id", "message_id").distinct().count() == messages.count()
    assert by_id(inc.read_current(spark, sink)) == by_id(build_passages(messages))


def test_repeated_batch_changes_nothing(spark, batches, tmp_path):
    messages, parts, _ = batches
    sink = str(tmp_path / "sink")
    build = lambda m: build_turns(m, gap_seconds=86_400, numbered=False)
    for i, part in enumerate(parts):
        inc.rebuild_batch(part, i, sink, build, "turns")
        if i % 2:
            inc.rebuild_batch(part, i, sink, build, "turns")
    assert inc.read_messages(spark, sink).count() == messages.count()
    assert by_id(inc.read_current(spark, sink, "turns")) == by_id(build(messages))
    # Batches in another order end in the same tables; an old sink under a new checkpoint is refused.
    late = str(tmp_path / "late")
    for i, part in enumerate(reversed(parts)):
        inc.rebuild_batch(part, i, late, build, "turns")
    assert by_id(inc.read_current(spark, late, "turns")) == by_id(build(messages))
    with pytest.raises(ValueError, match="later batches"):
        inc.rebuild_batch(parts[0], 0, late, build, "turns")


def test_enrichment_is_resumable(spark, batches, tmp_path):
    messages, parts, _ = batches
    sink, keys = str(tmp_path / "scores"), ["conversation_id", "message_id"]
    fn = lambda df: df.select(*keys, F.length("text").alias("score"))
    for i, part in enumerate([parts[0], parts[0], parts[1], parts[1].unionAll(parts[2])]):
        inc.enrich_batch(part, i, sink, keys, fn)
        inc.enrich_batch(part, i, sink, keys, fn)
    results = spark.read.parquet(sink)
    assert results.count() == 750 == results.select(*keys).distinct().count()
    step = inc.enrich_newest(messages, results, keys, "sent_at", 10, fn)
    assert {r.message_id for r in step.collect()} == set(range(990, 1000))
    assert inc.latest_result(results, keys).count() == 750


# --- tools ------------------------------------------------------------------


def test_tools(spark, sf):
    raw = archive(spark, sf)
    contacts = load_contacts(address_books(spark, sf))
    messages = messages_from_conversations(spark, sf).selectExpr(
        "*", "CAST(NULL AS STRING) AS sender_name", "'chat' AS service", "'mail a@b.org' AS subject", "false AS is_reply",
        "array(speaker) AS person_ids")
    passages = build_passages(messages).withColumn("embedding", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")))
    turns = tone.score_tone(build_turns(messages), lambda t: np.ones((len(t), 3)))
    windows = tone.score_tone(build_exchange_windows(turns), lambda t: np.ones((len(t), 3)))
    box = Toolbox(
        KEY, raw, contacts, messages, None, store_token_index(messages, ["conversation_id", "message_id"]), passages,
        store_token_index(passages, "passage_id"), turns, windows, calendar_from_events(spark, sf), lambda q: [1.0, 0.5])
    answers = {
        "info": box.database_info(), "conversations": box.list_conversations(limit=3), "people": box.list_people(limit=3),
        "read": box.read_conversation("1", limit=3), "search": box.search_messages("e", limit=5), "words": box.search_messages("er", limit=5),
        "context": box.search_context("er", limit=4), "tone": box.tone_analysis("year"), "stats": box.conversation_stats(),
        "sample": box.sample_conversation("1", limit=5), "calendar": box.calendar_info(),
        "events": box.search_calendar_events("click", limit=3),
    }
    event_id = answers["events"].raw["events"].first().event_id
    answers["event"] = box.read_calendar_events([event_id])
    for name, answer in answers.items():
        first = next(iter(answer.shown.values()))
        assert first.count() > 0, name
        assert first.columns == next(iter(answer.raw.values())).columns
    shown = answers["read"].shown["messages"].collect()
    assert all(r.subject == "mail [redacted: email address]" for r in shown)
    summary = answers["read"].privacy_redactions().first()
    assert summary.total >= len(shown) and "email address" in summary.categories
