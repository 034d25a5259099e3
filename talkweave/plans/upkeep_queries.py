"""Calendar, threads, table maintenance, streams."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..functions.clock import iso_text
from ..operators import agenda, threads, tone
from ..operators.filters import in_period
from ..operators.segment import build_passages, number_turns
from ..operators.stats import public_times
from ..session import shared_folder
from ..sources import buckets, tables
from ..sources.calendar import dedupe_calendar, load_calendar, write_calendar
from ..sources.driver_tables import KEY, calendar_from_events, messages_from_events, table, threads_from_conversations
from ..streaming import incremental as inc
from ..streaming.totals import read_by_day, read_totals, stream_totals
from ..streaming.turns import stream_turns
from . import sql as q
from .catalog import query
from .segment_queries import EVENT_TURNS, GAP, SHOWN, TURN_COLUMNS, _passages_sql, _shown, _turns, counting_scorer

C = q.with_(q.CALENDAR)
CAL_ID, EVENT_ID = q.opaque("calendar", "calendar_id", 22), q.opaque("event", "source_id", 22)


@query("calendar_info", C + f"""SELECT {CAL_ID} AS calendar_id, calendar AS name, count(*) AS event_count,
  {q.iso('min(start_at)')} AS first_start, {q.iso('max(end_at)')} AS last_end, (SELECT count(*) FROM cal) AS total_events
  FROM cal GROUP BY calendar_id, calendar""".replace("GROUP BY calendar_id, calendar", "GROUP BY cal.calendar_id, calendar"))
def calendar_info(spark, sf):
    return public_times(agenda.calendar_info(calendar_from_events(spark, sf), KEY), "first_start", "last_end")


VIEW = f"""{EVENT_ID} AS event_id, title, {q.iso('start_at')} AS start_at, {q.iso('end_at')} AS end_at, is_all_day,
  {q.opaque("calendar", "cal.calendar_id", 22)} AS calendar_id, calendar, location, coalesce(status, 'none') AS status, 'not_supported' AS availability"""
MATCH = """(contains(lower(title), 'room 1') OR contains(lower(calendar), 'room 1') OR contains(lower(location), 'room 1') OR contains(lower(notes), 'room 1'))
  AND end_at >= TIMESTAMP '2024-01-08 06:00:00' AND start_at < TIMESTAMP '2024-01-20'"""


@query("calendar_search", C + f"""SELECT {VIEW}, notes AS notes_preview, (SELECT count(*) FROM cal WHERE {MATCH}) AS total_matches,
  least((SELECT count(*) FROM cal WHERE {MATCH}), 200) AS returned FROM (SELECT * FROM cal WHERE {MATCH} ORDER BY cal.start_at, source_id LIMIT 200) cal""")
def calendar_search(spark, sf):
    rows = agenda.search_calendar_events(
        calendar_from_events(spark, sf), KEY, " Room 1", since="2024-01-08T06:00:00Z",
        until="2024-01-20T00:00:00Z", limit=200,
    )
    return public_times(rows, "start_at", "end_at")


@query("calendar_search_by_calendar", C + f"""SELECT {EVENT_ID} AS event_id, title FROM cal
  WHERE cal.calendar_id IN ('click', 'error') AND start_at < TIMESTAMP '2024-01-03' ORDER BY cal.start_at, source_id LIMIT 1000""")
def calendar_search_by_calendar(spark, sf):
    events = calendar_from_events(spark, sf)
    ids = [q.opaque_value("calendar", name, 22) for name in ("click", "error")]
    rows = agenda.search_calendar_events(
        events, KEY, calendar_ids=ids, until="2024-01-03T00:00:00Z", limit=1_000
    )
    return rows.select("event_id", "title")


@query("calendar_default_period", C + f"""SELECT {EVENT_ID} AS event_id, title, count(*) OVER () AS total_matches, count(*) OVER () AS returned
  FROM cal WHERE end_at >= TIMESTAMP '2024-01-10' AND start_at < TIMESTAMP '2025-01-10'""")
def calendar_default_period(spark, sf):
    """Without a condition: the year that starts on the day of `now`, and all its events."""
    rows = agenda.search_calendar_events(calendar_from_events(spark, sf), KEY, now=datetime(2024, 1, 10, 15, 30))
    return rows.select("event_id", "title", "total_matches", "returned")


@query("calendar_event_view", C + f"SELECT {VIEW}, notes FROM cal")
def calendar_event_view(spark, sf):
    rows = agenda.calendar_event_view(calendar_from_events(spark, sf), KEY, full=True)
    return public_times(rows, "start_at", "end_at")


@query("read_calendar_events", C + f"""SELECT {VIEW}, notes, 4 AS requested, 3 AS found
  FROM cal WHERE source_id IN ('10', '20', '30')""")
def read_calendar_events(spark, sf):
    events = calendar_from_events(spark, sf)
    ids = [q.opaque_value("event", name, 22) for name in ("10", "20", "30")]
    rows = agenda.read_calendar_events(events, KEY, [*ids, "event_unknown"])
    return public_times(rows, "start_at", "end_at")


@query("deduped_calendar", f"""SELECT concat(event_type, '|e', user_id, '|', strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ')) AS source_id,
  max_by(CASE WHEN event_type = 'view' THEN 'Untitled event' ELSE event_type || ' ' || event_id END, event_id) AS title,
  max(event_id) AS last_read FROM events GROUP BY event_type, user_id, date_trunc('day', ts)""")
def deduped_calendar(spark, sf):
    reads = table(spark, sf, "events").selectExpr(
        "event_id AS read_order", "event_id AS last_read", "event_type AS calendar_id",
        "concat('e', user_id) AS identifier", "date_trunc('day', ts) AS start_at",
        "CASE WHEN event_type = 'view' THEN '  ' ELSE concat(event_type, ' ', event_id) END AS title",
    )
    return dedupe_calendar(reads).select("source_id", "title", "last_read")


@query("calendar_snapshot", C + f"SELECT source_id, title, {q.iso('start_at')} AS start_at, {q.iso('end_at')} AS end_at, is_all_day, location, notes FROM cal")
def calendar_snapshot(spark, sf):
    """Written as snapshot files and read back."""
    path = f"{shared_folder(spark)}/calendar-{uuid.uuid4().hex}"
    write_calendar(
        calendar_from_events(spark, sf), path, "2024-02-01T00:00:00Z", "2000-01-01T00:00:00Z",
        "2029-01-01T00:00:00Z", per_file=2_000,
    )
    rows = load_calendar(spark, path)
    return public_times(rows, "start_at", "end_at").select(
        "source_id", "title", "start_at", "end_at", "is_all_day", "location", "notes"
    )


# --- threads ----------------------------------------------------------------

T = q.with_(q.THREADS)


@query("thread_summaries", T + f"""SELECT thread_id, max_by(content, id) AS preview, count(*) AS message_count,
  {q.iso('min(created_at)')} AS created_at, {q.iso('max(created_at)')} AS updated_at FROM threads GROUP BY 1""")
def thread_summaries(spark, sf):
    rows = threads.thread_summaries(threads_from_conversations(spark, sf))
    return public_times(rows, "created_at", "updated_at")


def _settled(status: str) -> str:
    return T + f"""SELECT thread_id, id, role, CASE WHEN role = 'user' AND delivery_status = '{status}' THEN
  CASE WHEN EXISTS (SELECT 1 FROM threads r WHERE r.thread_id = t.thread_id AND r.id > t.id AND r.role = 'assistant')
  THEN 'delivered' ELSE 'failed' END ELSE delivery_status END AS delivery_status FROM threads t"""


def _status(df):
    return df.select("thread_id", "id", "role", "delivery_status")


@query("reconciled_delivery", _settled("sending"))
def reconciled_delivery(spark, sf):
    return _status(threads.reconcile_delivery(threads_from_conversations(spark, sf)))


@query("flagged_orphans", _settled("delivered"))
def flagged_orphans(spark, sf):
    return _status(threads.flag_orphans(threads_from_conversations(spark, sf)))


@query("stale_snapshots", """SELECT o_orderkey, (status <> 'refreshing') AND (version <> 4 OR content IS NULL OR new >= 250
    OR (new > 0 AND o_orderdate < TIMESTAMP '1996-06-30 12:00:00' - INTERVAL 1 DAY)) AS stale FROM (
  SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'refreshing' ELSE 'idle' END AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 4 END AS version,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS content, 1000 - o_custkey % 1200 AS new FROM orders)""")
def stale_snapshots(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_orderdate AS updated_at",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'refreshing' ELSE 'idle' END AS status",
        "CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 4 END AS format_version",
        "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS content",
        "o_custkey % 1200 AS source_message_count",
    )
    return threads.snapshot_is_stale(rows, 1_000, "1996-06-30T12:00:00Z").select("o_orderkey", "stale")


@query("ordered_dedupe", """SELECT l_suppkey, value, place FROM (
  SELECT l_suppkey, value, row_number() OVER (PARTITION BY l_suppkey ORDER BY min(o), value) AS place
  FROM (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS o,
    concat('ships ', l_shipdate::DATE, ' ', l_returnflag) AS value FROM lineitem) GROUP BY l_suppkey, value) WHERE place <= 6""")
def ordered_dedupe(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey", "l_orderkey * 10 + l_linenumber AS o",
        "concat(' ships   ', CAST(l_shipdate AS DATE), '\t', l_returnflag) AS value",
    )
    return threads.ordered_dedupe(rows, "l_suppkey", "value", "o")


# --- maintenance ------------------------------------------------------------


@query("append_new", """SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'""")
def append_new(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    stored = orders.filter("o_orderdate < '1996-01-01'")
    batch = orders.filter("o_orderdate >= '1995-01-01'")
    return tables.append_new(stored, batch.unionAll(batch), ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("upsert", """SELECT o_custkey, max_by(o_orderkey, o_orderdate + to_seconds(o_orderkey)) AS last_order FROM (
  SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01') GROUP BY 1
  UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders GROUP BY 1 HAVING max(o_orderdate) < TIMESTAMP '1996-01-01'""")
def upsert(spark, sf):
    orders = table(spark, sf, "orders")
    stored = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("last_order"))
    batch = orders.filter("o_orderdate >= '1996-01-01'").selectExpr(
        "o_custkey", "o_orderkey AS last_order",
        "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) + o_orderkey AS at",
    )
    result = tables.upsert(stored, batch, ["o_custkey"], "at")
    return result.select("o_custkey", "last_order")


@query("replaced_conversations", """SELECT CAST(user_id AS VARCHAR) AS conversation_id, event_id,
  CASE WHEN user_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM events WHERE user_id % 6 <> 3""")
def replaced_conversations(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "CAST(user_id AS STRING) AS conversation_id", "user_id", "event_id"
    )
    stored = rows.withColumn("version", F.lit("old"))
    changed = rows.filter("user_id % 3 = 0")
    rebuilt = changed.filter("user_id % 6 = 0").withColumn("version", F.lit("new"))
    result = tables.replace_conversations(stored, rebuilt, changed)
    return result.select("conversation_id", "event_id", "version")


@query("replaced_in_place", """SELECT CAST(user_id AS VARCHAR) AS conversation_id, event_id,
  CASE WHEN user_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM events WHERE user_id % 6 <> 3""")
def replaced_in_place(spark, sf):
    """The same, on a table that is stored in buckets; half of the changed conversations have no rows any more."""
    rows = table(spark, sf, "events").selectExpr("CAST(user_id AS STRING) AS conversation_id", "user_id", "event_id")
    path = _sink(spark, "buckets")
    stored = rows.select("conversation_id", "event_id", F.lit("old").alias("version"))
    buckets.write_buckets(stored, path, ["conversation_id"], ("conversation_id", "event_id"))
    changed = rows.filter("user_id % 3 = 0")
    rebuilt = changed.filter("user_id % 6 = 0").select("conversation_id", "event_id", F.lit("new").alias("version"))
    buckets.replace_in_place(spark, path, rebuilt, changed, ("conversation_id", "event_id"))
    return buckets.read_buckets(spark, path)


@query("upserted_in_place", """SELECT o_custkey, max_by(o_orderkey, o_orderdate + to_seconds(o_orderkey)) AS last_order FROM (
  SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01') GROUP BY 1
  UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders GROUP BY 1 HAVING max(o_orderdate) < TIMESTAMP '1996-01-01'""")
def upserted_in_place(spark, sf):
    orders = table(spark, sf, "orders")
    path = _sink(spark, "buckets")
    stored = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("last_order"))
    buckets.write_buckets(stored, path, ["o_custkey"], ("o_custkey",))
    batch = orders.filter("o_orderdate >= '1996-01-01'").selectExpr(
        "o_custkey", "o_orderkey AS last_order",
        "unix_seconds(CAST(o_orderdate AS TIMESTAMP)) + o_orderkey AS at",
    )
    buckets.upsert_in_place(spark, path, batch, ["o_custkey"], "at")
    return buckets.read_buckets(spark, path)


@query("written_index", _passages_sql("event_messages") + SHOWN)
def written_index(spark, sf):
    """The passage index written with its layout, then read whole."""
    return _shown(_written(spark, sf))


@query("written_index_since", _passages_sql("event_messages") + SHOWN + " WHERE start_at >= TIMESTAMP '2024-01-10'")
def written_index_since(spark, sf):
    """The same, of which only the folders of some dates are read."""
    return _shown(in_period(_written(spark, sf), "start_at", since="2024-01-10T00:00:00Z"))


def _written(spark, sf):
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    tables.write_index(build_passages(messages_from_events(spark, sf)), path)
    return spark.read.parquet(path)


# --- streams ----------------------------------------------------------------


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return _as_messages(spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet"))


def _as_messages(stream):
    return stream.selectExpr(
        "CAST(user_id AS STRING) AS conversation_id", "event_id AS message_id", "ts AS sent_at",
        "CASE WHEN event_type IN ('purchase', 'click') THEN 'from_me' ELSE 'to_me' END AS direction",
        "concat(event_type, ' ', props) AS text",
    )


def _late_batches(spark, sf):
    """The events in five parts, each with ids below those already seen.

    A part is written, with as many files as it has tasks, and then a stream over all that is
    there is started on the same checkpoint, which reads what is new.
    """
    rows = table(spark, sf, "events")
    folder = _sink(spark, "events")
    part = F.when(F.col("event_id") % 50 == 7, 4).otherwise(F.pmod(F.floor(F.col("event_id") / 64), F.lit(4)))
    for place in range(5):
        rows.where(part == place).write.mode("append").parquet(folder)
        yield _as_messages(spark.readStream.schema(rows.schema).parquet(folder))


def _sink(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("streamed_index", q.with_(q.EVENT_MESSAGES) + "SELECT conversation_id, message_id, direction, text FROM event_messages")
def streamed_index(spark, sf):
    sink = _sink(spark, "stream-index")
    for stream in _late_batches(spark, sf):
        inc.stream_index(stream, sink, f"{sink}/checkpoint").awaitTermination()
    return inc.read_messages(spark, sink).select("conversation_id", "message_id", "direction", "text")


@query("streamed_passages", _passages_sql("event_messages") + SHOWN)
def streamed_passages(spark, sf):
    sink = _sink(spark, "stream-rebuild")
    inc.stream_rebuild(
        _event_stream(spark, sf), sink, f"{sink}/checkpoint", build_passages
    ).awaitTermination()
    return _shown(inc.read_current(spark, sink))


@query("streamed_passages_late", _passages_sql("event_messages") + SHOWN)
def streamed_passages_late(spark, sf):
    """Five batches with late rows end in the same passages."""
    sink = _sink(spark, "stream-late")
    for stream in _late_batches(spark, sf):
        inc.stream_rebuild(stream, sink, f"{sink}/checkpoint", build_passages).awaitTermination()
    return _shown(inc.read_current(spark, sink))


@query("streamed_scores", q.with_(q.EVENT_MESSAGES, q.scored("s", "event_messages")) + "SELECT message_id, round(positive, 4) AS positive FROM s")
def streamed_scores(spark, sf):
    sink = _sink(spark, "stream-enrich")
    for stream in _late_batches(spark, sf):
        inc.stream_enrich(
            stream, f"{sink}/scores", f"{sink}/checkpoint",
            ["conversation_id", "message_id"], lambda df: tone.score_tone(df, counting_scorer),
        ).awaitTermination()
    scores = spark.read.option("basePath", f"{sink}/scores").parquet(f"{sink}/scores")
    return scores.select("message_id", F.round("positive", 4).alias("positive"))


#: Every tenth message is also in a second conversation.
SHARED = q.with_(q.EVENT_MESSAGES, """shared AS (SELECT conversation_id, message_id, direction, sent_at FROM event_messages
  UNION ALL SELECT concat(conversation_id, 'b'), message_id, direction, sent_at FROM event_messages WHERE message_id % 10 = 3)""")


def _stream_shared(spark, sf):
    sink = _sink(spark, "stream-totals")
    second = F.when(F.col("message_id") % 10 == 3, F.array("conversation_id", F.concat("conversation_id", F.lit("b"))))
    names = F.explode(F.coalesce(second, F.array("conversation_id")))
    for stream in _late_batches(spark, sf):
        stream_totals(stream.withColumn("conversation_id", names), sink, f"{sink}-checkpoint").awaitTermination()
    return sink


@query("maintained_totals", SHARED + f"""SELECT count(DISTINCT message_id) AS messages,
  count(DISTINCT message_id) FILTER (direction = 'from_me') AS from_me,
  count(DISTINCT message_id) FILTER (direction = 'to_me') AS to_me,
  {q.iso('min(sent_at)')} AS first_message_at, {q.iso('max(sent_at)')} AS last_message_at,
  count(DISTINCT conversation_id) AS conversations FROM shared""")
def maintained_totals(spark, sf):
    """Five batches, late rows among them, folded from their summaries."""
    return public_times(read_totals(spark, _stream_shared(spark, sf)), "first_message_at", "last_message_at")


@query("maintained_by_day", SHARED + """SELECT strftime(sent_at, '%Y-%m-%d') AS day, count(DISTINCT message_id) AS messages,
  count(DISTINCT message_id) FILTER (direction = 'from_me') AS from_me,
  count(DISTINCT message_id) FILTER (direction = 'to_me') AS to_me FROM shared GROUP BY 1""")
def maintained_by_day(spark, sf):
    return read_by_day(spark, _stream_shared(spark, sf))


@query("streamed_turns", EVENT_TURNS + TURN_COLUMNS)
def streamed_turns(spark, sf):
    """The stream is started three times on one checkpoint; some events come a third of the time too late.

    A last message far in the future moves the watermark past every gap.
    """
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "props")
    begin, end = rows.agg(F.min("ts"), F.max("ts")).first()
    step = (end - begin) / 3
    place = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(begin).cast("timestamp"))) / F.lit(step.total_seconds() * 1e6))
    place = F.least(place + F.when(F.col("event_id") % 50 == 7, 1).otherwise(0), F.lit(2))
    last = rows.limit(1).withColumns({"user_id": F.lit(-1).cast(rows.schema["user_id"].dataType), "ts": F.col("ts") + F.expr("interval 4000 days")})
    folder, sink = _sink(spark, "events"), _sink(spark, "stream-turns")
    for n in range(3):
        part = rows.where(place == n)
        (part if n < 2 else part.unionAll(last.select(*rows.columns))).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        speaker = "CASE WHEN event_type IN ('purchase', 'click') THEN 'me' ELSE event_type END AS speaker"
        messages = stream.selectExpr(
            "CAST(user_id AS STRING) AS conversation_id", "event_id AS message_id", "ts AS sent_at",
            "CASE WHEN event_type IN ('purchase', 'click') THEN 'from_me' ELSE 'to_me' END AS direction",
            speaker, "concat(event_type, ' ', props) AS text",
        )
        delay = f"{int(step.total_seconds()) + 60} seconds"
        stream_turns(messages, sink, f"{sink}-checkpoint", delay=delay, gap_seconds=GAP).awaitTermination()
    closed = spark.read.parquet(sink).where("not late").drop("late")
    return _turns(number_turns(closed))
