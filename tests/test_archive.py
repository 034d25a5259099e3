import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from talkweave.operators import reading, stats
from talkweave.operators.ranking import rank_by_id, rank_by_time
from talkweave.sources import archive as arc
from talkweave.sources import contacts as con
from talkweave.sources import tables

KEY = b"secret"
T0 = 700_000_000


@pytest.fixture(scope="module")
def raw(spark):
    message = [
        (1, "hello", None, None, 0, "chat", None, 1, T0, 0),
        (2, None, "decoded a@b.org", "Re", 1, "chat", "g1", 0, (T0 + 60) * 10**9, 0),
        (3, "joined", None, None, 0, "chat", None, 1, T0 + 70, 1),
        (4, "both", None, None, 0, "sms", None, 2, T0 + 80, 0),
        (5, None, None, None, 0, "sms", None, None, T0 + 90, 0),
        (6, "last", None, None, 0, "sms", None, 3, T0 + 100, 0),
    ]
    frames = {
        "message": (message, "rowid long, text string, decoded_text string, subject string, is_from_me int, service string, reply_to_guid string, handle_id long, date long, item_type int"),
        "chat": ([(1, "Family", "c1", "chat", 0), (2, None, "c2", "sms", 1), (3, "call 555 010 9999", "c3", "sms", None), (4, None, "c4", "sms", 0)], "rowid long, display_name string, chat_identifier string, service_name string, is_archived int"),
        "handle": ([(1, "+1 (555) 010-0001"), (2, "x@y.org"), (3, ""), (4, "555 010 0004")], "rowid long, id string"),
        "chat_message": ([(1, 1), (1, 2), (1, 3), (1, 4), (2, 4), (2, 5), (3, 6), (1, 1)], "chat_id long, message_id long"),
        "chat_handle": ([(1, 1), (1, 2), (2, 2), (3, 3), (3, 4), (4, 4)], "chat_id long, handle_id long"),
        "attachment": ([(1, "/a/b/IMG.JPEG", None, "image/jpeg"), (1, "/a/b", " ", None), (1, "/a/noext", None, "x")], "message_id long, filename string, transfer_name string, mime_type string"),
    }
    return {k: spark.createDataFrame(r, s) for k, (r, s) in frames.items()}


@pytest.fixture(scope="module")
def contacts(spark):
    first = spark.createDataFrame(
        [(1, "Ann", "Lee", "Org", "Boss"), (2, None, None, "Only Org", None), (9, None, None, None, None)],
        "id long, first_name string, last_name string, organization string, job_title string")
    first_keys = spark.createDataFrame([(1, "555-010-0001"), (2, "X@Y.org"), (9, "555 010 7777")], "owner long, value string")
    second = spark.createDataFrame(
        [(1, "Other", "Name", "Nick"), (2, " ", None, "Zed")], "id long, first_name string, last_name string, nickname string")
    second_keys = spark.createDataFrame([(1, "+1 555 010 0001"), (2, "5550100004"), (2, "--")], "owner long, value string")
    return con.load_contacts([(first, first_keys), (second, second_keys)])


def test_contacts(contacts):
    got = {r.identifier_key: (r.name, r.nickname, r.company) for r in contacts.collect()}
    assert got == {
        "15550100001": ("Ann Lee", None, "Org"),
        "x@y.org": ("Only Org", None, "Only Org"),
        "15550100004": ("Zed", "Zed", None),
    }


def test_messages(raw, contacts):
    people = con.enrich_people(arc.handle_people(raw["handle"], KEY), contacts)
    assert {r.name: r.nickname for r in people.collect()} == {"Ann Lee": None, "Only Org": None, "Zed": None, "Unknown person": None}
    rows = arc.normalize_messages(raw, KEY, people.select("person_id", "name"), with_attachments=True)
    got = {(r.conversation_id, r.message_id): r for r in rows.collect()}
    ids = {r.chat_id: r.conversation_id for r in arc.conversation_ids(raw["chat"], KEY).collect()}
    assert set(got) == {(ids[c], m) for c, m in [(1, 1), (1, 2), (1, 4), (2, 4), (2, 5), (3, 6)]}
    second = got[ids[1], 2]
    assert (second.text, second.direction, second.speaker, second.is_reply) == ("decoded [redacted: email address]", "from_me", "me", True)
    assert second.sent_at - got[ids[1], 1].sent_at == dt.timedelta(seconds=60)
    assert got[ids[1], 1].sender_name == "Ann Lee" and got[ids[2], 5].speaker == "unknown"
    assert got[ids[3], 6].speaker == "unknown" and len(got[ids[1], 1].person_ids) == 2
    names = [(a.name, a.mime_type) for a in got[ids[1], 1].attachments]
    assert sorted(names, key=str) == [("[attachment]", "x"), ("[attachment].jpeg", "image/jpeg"), (None, None)]
    totals = stats.conversation_totals(rows).first()
    assert (totals.messages, totals.from_me, totals.to_me, totals.conversations) == (5, 1, 4, 3)
    only = arc.normalize_messages(raw, KEY, chats=raw["chat"].filter("rowid = 2").selectExpr("rowid AS chat_id"))
    assert {(r.conversation_id, r.message_id) for r in only.collect()} == {(ids[2], 4), (ids[2], 5)}


def test_listings(raw, contacts):
    assert tuple(stats.database_info(raw).first()) == (5, 3, 4)
    rows = stats.list_conversations(raw, contacts, KEY).collect()
    assert [r.name for r in rows] == ["Zed", "Only Org", "Family", "Zed"]
    assert [r.archived for r in rows] == [False, True, False, False]
    assert rows[3].last_message_at is None
    assert [r.name for r in stats.list_conversations(raw, contacts, KEY, "ann l").collect()] == ["Family"]
    assert [r.name for r in stats.list_conversations(raw, contacts, KEY, "C2").collect()] == ["Only Org"]
    assert [r.name for r in stats.list_conversations(raw, contacts, KEY, "%").collect()] == []
    people = stats.list_people(raw, contacts, KEY).collect()
    assert [(r.name, r.conversation_count) for r in people[:3]] == [("Unknown person", 1), ("Zed", 2), ("Only Org", 2)]
    assert [r.name for r in stats.list_people(raw, contacts, KEY, "boss").collect()] == ["Ann Lee"]
    index = stats.indexable_conversations(raw, contacts, KEY).collect()
    assert sorted((r.chat_id, r.message_count) for r in index) == [(1, 3), (2, 2), (3, 1)]
    chats = reading.resolve_chats(raw, KEY, [r.conversation_id for r in rows[:2]])
    assert sorted(r.chat_id for r in chats.collect()) == [2, 3]
    with pytest.raises(Exception, match="no such conversation_id: conv_nothing"):
        reading.resolve_chats(raw, KEY, ["conv_nothing"]).collect()


def test_load_archive(spark, raw, tmp_path):
    for name, df in raw.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    loaded = arc.load_archive(spark, str(tmp_path))
    assert loaded["message"].count() == 6
    with pytest.raises(ValueError, match="handle"):
        arc.load_archive(spark, {"message": "x"})


def talk(spark, seed, n, conversation="a"):
    rng = random.Random(seed)
    stamps = [None, 0, 1, 59, 60, 61, 3600, 3601, 10**6]
    rows = []
    for i in rng.sample(range(-50, 5 * n), n):
        at = rng.choice(stamps)
        rows.append((conversation, i, None if at is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at), "t"))
    return spark.createDataFrame(rows, "conversation_id string, message_id long, sent_at timestamp_ntz, text string"), rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[2] is not None, r[2] or dt.datetime.min, r[1]))


@pytest.mark.parametrize("bits", [2, 5, 20])
def test_exact_ranks(spark, bits):
    df, rows = talk(spark, 1, 300)
    got = {r.message_id: (r.rank, r.total) for r in rank_by_time(df, ["conversation_id"], "sent_at", "message_id", bits=bits).collect()}
    assert got == {r[1]: (i + 1, 300) for i, r in enumerate(in_order(rows))}
    got = {r.message_id: r.rank for r in rank_by_id(df, ["conversation_id"], "message_id", bits=bits).collect()}
    assert got == {r[1]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: r[1]))}


@pytest.mark.parametrize("n,limit", [(3, 5), (20, 20), (39, 20), (40, 20), (101, 7), (300, 60)])
def test_samples(spark, n, limit):
    df, rows = talk(spark, n, n)
    order = [r[1] for r in in_order(rows)]
    step = max(1, n // limit)
    want = order if n <= limit else order[::step][:limit]
    assert [r.message_id for r in reading.sample_conversation(df, "a", limit).collect()] == want
    spread = order if n <= limit else [order[k * n // limit] for k in range(limit)]
    assert [r.message_id for r in reading.sample_conversation(df, "a", limit, spread=True).collect()] == spread


def test_pages(spark):
    df, rows = talk(spark, 4, 90)
    order = [r[1] for r in in_order(rows) if r[2] is not None]
    dated = df.filter("sent_at is not null")
    seen, before = [], None
    while True:
        page = reading.read_conversation(dated, "a", 20, before)
        seen = [r.message_id for r in page.collect()] + seen
        cursor = reading.next_cursor(page, 20).first()
        if cursor.message_id is None:
            break
        before = (cursor.sent_at, cursor.message_id)
    assert seen == order


def test_page_without_a_limit_has_all(spark):
    df, _ = talk(spark, 5, 400)
    every = [r.message_id for r in reading.newest(df, None).collect()]
    assert len(every) == df.count()
    for limit in (1, 50, 350, 1000):
        assert [r.message_id for r in reading.newest(df, limit).collect()] == every[:limit]


def test_table_maintenance(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 3, "x")], "conversation_id string, n int, v string")
    new = spark.createDataFrame([("a", 1, "y"), ("d", 4, "y"), ("d", 4, "z")], "conversation_id string, n int, v string")
    added = tables.append_new(old, new, ["conversation_id", "n"])
    assert [r.conversation_id for r in added.collect()] == ["d"]
    assert tables.append_new(old.unionAll(added), new, ["conversation_id", "n"]).count() == 0
    up = {r.conversation_id: r.v for r in tables.upsert(old, new, ["conversation_id"], "v").collect()}
    assert up == {"a": "y", "b": "x", "c": "x", "d": "z"}
    gone = spark.createDataFrame([("a",), ("b",)], "conversation_id string")
    kept = tables.replace_conversations(old, new.limit(1), gone).collect()
    assert sorted((r.conversation_id, r.v) for r in kept) == [("a", "y"), ("c", "x")]


def test_write_partitioned(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).selectExpr("id", "id % 2 AS part", "'a' AS v")
    tables.write_partitioned(df, path, "part", ("id",))
    tables.write_partitioned(df.filter("part = 1").withColumn("v", F.lit("b")), path, "part", ("id",))
    got = spark.read.parquet(path).groupBy("part", "v").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, "a", 5), (1, "b", 5)]
