"""Archive, people, activity, reading."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.clock import iso_text, normalize_epoch, parse_iso, period
from ..functions.identity import normalize_identifier, opaque_id, profile_name
from ..functions.redaction import safe_label
from ..operators import filters, reading, search, stats
from ..session import cut_lineage, shared_folder
from ..sources import archive as arc
from ..sources import contacts as con
from ..sources.driver_tables import (
    KEY, address_books, archive, messages_from_conversations, messages_from_documents,
    messages_from_events, table,
)
from . import sql as q
from .catalog import query

A = q.with_(*q.ARCHIVE)
EV = q.with_(q.EVENT_MESSAGES)


@query("database_info", A + """SELECT (SELECT count(*) FROM raw_message) AS messages,
  (SELECT count(*) FROM raw_chat c WHERE EXISTS (SELECT 1 FROM chat_message m JOIN raw_message r
     ON r.rowid = m.message_id WHERE m.chat_id = c.chat_id)) AS conversations,
  (SELECT count(*) FROM handle) AS people""")
def database_info(spark, sf):
    return stats.database_info(archive(spark, sf))


LISTED = f"""SELECT conversation_id, name, participants, service, archived,
  {q.iso('last_at')} AS last_message_at FROM directory"""


def _listed(df):
    return df.select(
        "conversation_id", "name", F.array_join("participants", ", ").alias("participants"),
        "service", "archived", iso_text(F.col("last_message_at")).alias("last_message_at"),
    )


@query("list_conversations", A + LISTED + " ORDER BY last_at DESC NULLS LAST, chat_id LIMIT 100")
def list_conversations(spark, sf):
    contacts = con.load_contacts(address_books(spark, sf))
    return _listed(stats.list_conversations(archive(spark, sf), contacts, KEY, limit=100))


@query("list_conversations_matching", A + LISTED + """ WHERE lower(display_name) LIKE '%nick1%'
  OR lower(chat_identifier) LIKE '%nick1%' OR profiles LIKE '%nick1%'
  OR chat_id IN (SELECT chat_id FROM chat_handle JOIN handle USING (handle_id)
    WHERE lower(identifier) LIKE '%nick1%')
  ORDER BY last_at DESC NULLS LAST, chat_id LIMIT 25""")
def list_conversations_matching(spark, sf):
    contacts = con.load_contacts(address_books(spark, sf))
    return _listed(stats.list_conversations(archive(spark, sf), contacts, KEY, "Nick1", limit=25))


@query("conversation_directory", A + LISTED)
def conversation_directory(spark, sf):
    contacts = con.load_contacts(address_books(spark, sf))
    return _listed(stats.conversation_directory(archive(spark, sf), contacts, KEY))


PEOPLE_LIST = f"""SELECT person_id, name, nickname, company, job_title, department,
  count(DISTINCT ch.chat_id) AS conversation_count, {q.iso('max(l.last_at)')} AS last_message_at
  FROM people p LEFT JOIN chat_handle ch USING (handle_id) LEFT JOIN last_dates l USING (chat_id)
  {{where}} GROUP BY ALL, p.handle_id ORDER BY max(l.last_at) DESC NULLS LAST, p.handle_id LIMIT {{limit}}"""


def _people_sql(where: str, limit: int) -> str:
    inner = PEOPLE_LIST.replace("GROUP BY ALL, p.handle_id",
        "GROUP BY p.handle_id, person_id, name, nickname, company, job_title, department")
    return A + inner.format(where=where, limit=limit)


@query("list_people", _people_sql("", 200))
def list_people(spark, sf):
    contacts = con.load_contacts(address_books(spark, sf))
    return stats.public_times(
        stats.list_people(archive(spark, sf), contacts, KEY, limit=200), "last_message_at"
    )


@query("list_people_matching", _people_sql(
    "WHERE lower(concat_ws(chr(10), name, nickname, company, job_title, department)) LIKE '%firm%' AND name <> 'Unknown person'", 50))
def list_people_matching(spark, sf):
    contacts = con.load_contacts(address_books(spark, sf))
    return stats.public_times(
        stats.list_people(archive(spark, sf), contacts, KEY, "firm", limit=50), "last_message_at"
    )


@query("indexable_conversations", A + """SELECT conversation_id, name, n AS message_count
  FROM directory JOIN (SELECT chat_id, count(DISTINCT message_id) AS n FROM chat_message
    JOIN raw_message r ON r.rowid = message_id GROUP BY 1) USING (chat_id)""")
def indexable_conversations(spark, sf):
    contacts = con.load_contacts(address_books(spark, sf))
    rows = stats.indexable_conversations(archive(spark, sf), contacts, KEY)
    return rows.select("conversation_id", "name", "message_count")


NORMALIZED = f"""SELECT d.conversation_id, m.rowid AS message_id, {q.iso('m.sent_at')} AS sent_at,
  CASE WHEN is_from_me THEN 'from_me' ELSE 'to_me' END AS direction,
  CASE WHEN is_from_me THEN 'me' ELSE coalesce(p.person_id, 'unknown') END AS speaker,
  CASE WHEN is_from_me THEN 'You' ELSE coalesce(p.name, 'Unknown person') END AS sender_name,
  m.service, m.subject, m.text, m.is_reply
  FROM raw_message m JOIN chat_message cm ON cm.message_id = m.rowid
  JOIN directory d USING (chat_id) LEFT JOIN people p ON p.handle_id = m.handle_id"""


def _normalized(spark, sf, named=True, **options):
    raw = archive(spark, sf)
    if not named:
        return arc.normalize_messages(raw, KEY, redacted=False, **options)
    contacts = con.load_contacts(address_books(spark, sf))
    people = con.enrich_people(arc.handle_people(raw["handle"], KEY), contacts)
    return arc.normalize_messages(raw, KEY, people.select("person_id", "name"), **options)


@query("normalized_messages", A + NORMALIZED)
def normalized_messages(spark, sf):
    rows = _normalized(spark, sf)
    return rows.select(
        "conversation_id", "message_id", iso_text(F.col("sent_at")).alias("sent_at"), "direction",
        "speaker", "sender_name", "service", "subject", "text", "is_reply",
    )


@query("index_content", A + f"""SELECT conversation_id, message_id,
  concat_ws(' — ', subject, text) AS content FROM ({NORMALIZED})""")
def index_content(spark, sf):
    rows = arc.index_content(_normalized(spark, sf, named=False))
    return rows.select("conversation_id", "message_id", "content")


@query("participants", A + """SELECT conversation_id, string_agg(person_id, ',' ORDER BY handle_id) AS person_ids
  FROM directory JOIN chat_handle USING (chat_id) JOIN people USING (handle_id) GROUP BY 1""")
def participants(spark, sf):
    raw = archive(spark, sf)
    rows = arc.participants(raw, KEY).join(arc.conversation_ids(raw["chat"], KEY), "chat_id")
    return rows.select(
        "conversation_id", F.array_join(F.col("people.person_id"), ",").alias("person_ids")
    )


@query("attachments_view", """SELECT message_id, string_agg(concat_ws('/', name, mime_type), ',' ORDER BY name NULLS FIRST, mime_type) AS attachments
  FROM (SELECT page_id // 2 AS message_id,
    CASE page_id % 3 WHEN 0 THEN '[attachment].jpg' WHEN 1 THEN NULL
      ELSE '[attachment]' || lower(regexp_extract(trim(url), '\\.[A-Za-z0-9]{1,10}$')) END AS name,
    CASE WHEN page_id % 3 = 0 THEN 'image/jpeg' ELSE 'text/html' END AS mime_type FROM pages)
  GROUP BY 1""")
def attachments_view(spark, sf):
    rows = arc.attachments_view(archive(spark, sf)["attachment"])
    shown = F.transform("attachments", lambda a: F.concat_ws("/", a["name"], a["mime_type"]))
    return rows.select("message_id", F.array_join(shown, ",").alias("attachments"))


CONTACT_COLUMNS = "identifier_key, name, nickname, company, job_title, department"


@query("contacts", q.with_(q.PROFILES) + f"SELECT {CONTACT_COLUMNS} FROM profiles")
def contacts(spark, sf):
    return con.load_contacts(address_books(spark, sf))


@query("match_contacts", q.with_(q.PROFILES) + f"""SELECT {CONTACT_COLUMNS} FROM profiles
  WHERE lower(concat_ws(chr(10), name, nickname, company, job_title, department)) LIKE '%dept 1%'""")
def match_contacts(spark, sf):
    return con.match_contacts(con.load_contacts(address_books(spark, sf)), "Dept 1")


@query("enriched_people", A + "SELECT handle_id, person_id, name, nickname, company, job_title, department FROM people")
def enriched_people(spark, sf):
    people = arc.handle_people(archive(spark, sf)["handle"], KEY)
    return con.enrich_people(people, con.load_contacts(address_books(spark, sf)))


@query("conversation_names", A + "SELECT chat_id, name FROM directory")
def conversation_names(spark, sf):
    raw = archive(spark, sf)
    contacts = con.load_contacts(address_books(spark, sf))
    people = con.enrich_people(arc.handle_people(raw["handle"], KEY), contacts)
    members = (
        raw["chat_handle"].dropDuplicates().join(people, "handle_id").groupBy("chat_id")
        .agg(F.sort_array(F.collect_list(F.struct("handle_id", "name"))).alias("p"))
        .select("chat_id", F.col("p.name").alias("names"))
    )
    chats = raw["chat"].select(F.col("rowid").alias("chat_id"), "display_name")
    return stats.name_conversations(chats, members)


@query("opaque_ids", f"SELECT c_custkey, {q.opaque('person', 'c_name')} AS person_id, {q.opaque('event', 'c_custkey', 22)} AS event_id FROM customer")
def opaque_ids(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        opaque_id("person", F.col("c_name"), KEY).alias("person_id"),
        opaque_id("event", F.col("c_custkey"), KEY, 22).alias("event_id"),
    )


@query("resolved_people", A + f"""SELECT handle_id, person_id FROM people WHERE c_custkey_of IN (1, 2, 3)"""
       .replace("c_custkey_of", "handle_id - 1"))
def resolved_people(spark, sf):
    people = arc.handle_people(archive(spark, sf)["handle"], KEY)
    names = ("customer1@example.com", "+1 (555) 0000002", "customer3@example.com")
    wanted = [q.opaque_value("person", name) for name in names]
    return reading.resolve_ids(people, "person_id", wanted, "person_id").select("handle_id", "person_id")


@query("normalized_epochs", f"""SELECT event_id, {q.iso("date_trunc('second', ts)")} AS sent_at FROM events""")
def normalized_epochs(spark, sf):
    raw = archive(spark, sf)["message"]
    return raw.select(
        F.col("rowid").alias("event_id"), iso_text(normalize_epoch(F.col("date"))).alias("sent_at")
    )


@query("parsed_times", f"""SELECT event_id, {q.iso('ts')} AS exact, {q.iso("date_trunc('second', ts)")} AS whole,
  CAST(NULL AS VARCHAR) AS bad FROM events""")
def parsed_times(spark, sf):
    texts = table(spark, sf, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("exact"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("whole"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("bad"),
    )
    return texts.select(
        "event_id", *[iso_text(parse_iso(F.col(c))).alias(c) for c in ("exact", "whole", "bad")]
    )


@query("periods", """SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year,
  strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS quarter,
  strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m') AS other FROM orders""")
def periods(spark, sf):
    at = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        *[period(at, b).alias(b) for b in ("year", "quarter", "month")],
        period(at, "week").alias("other"),
    )


@query("normalized_identifiers", """SELECT c_custkey, lower(trim(c_name)) || '@x.org' AS mail,
  CASE WHEN length(d) = 10 THEN '1' || d ELSE d END AS phone
  FROM (SELECT *, '555' || lpad(CAST(c_custkey AS VARCHAR), 6 + CAST(c_custkey % 3 AS INT), '0') AS d FROM customer)""")
def normalized_identifiers(spark, sf):
    raw = table(spark, sf, "customer").selectExpr(
        "c_custkey",
        "concat('\t ', upper(c_name), '@X.org ') AS mail",
        "concat(' (555) ', lpad(c_custkey, 6 + CAST(c_custkey % 3 AS INT), '0'), ' -') AS phone",
    )
    return raw.select(
        "c_custkey", *[normalize_identifier(F.col(c)).alias(c) for c in ("mail", "phone")]
    )


@query("profile_names", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN trim(concat_ws(' ', c_mktsegment,
    CASE WHEN c_custkey % 4 = 0 THEN c_name END))
  WHEN c_custkey % 3 = 0 THEN 'nick' ELSE 'org' END AS name FROM customer""")
def profile_names(spark, sf):
    rows = table(spark, sf, "customer")
    return rows.select(
        "c_custkey",
        profile_name(
            F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END"),
            F.expr("CASE WHEN c_custkey % 4 = 0 THEN c_name END"),
            F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'nick' END"),
            F.lit("org"),
        ).alias("name"),
    )


@query("safe_labels", """SELECT event_id, CASE event_type WHEN 'click' THEN NULL WHEN 'error' THEN NULL
  WHEN 'view' THEN NULL ELSE concat('Group ', user_id % 1000) END AS label FROM events""")
def safe_labels(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE event_type WHEN 'click' THEN concat('u', user_id, '@example.com') "
        "WHEN 'error' THEN '  ' WHEN 'view' THEN concat('see https://x.org/', user_id) "
        "ELSE concat(' Group ', user_id % 1000, ' ') END AS label",
    )
    return rows.select("event_id", safe_label(F.col("label")).alias("label"))


# --- activity ---------------------------------------------------------------

TWICE = q.with_(*q.ARCHIVE, f"m AS ({NORMALIZED})")
ONCE = "(SELECT message_id, min(direction) AS direction, min(sent_at) AS sent_at FROM m GROUP BY 1)"


@query("conversation_totals", TWICE + f"""SELECT count(*) AS messages,
  count(*) FILTER (direction = 'from_me') AS from_me, count(*) FILTER (direction = 'to_me') AS to_me,
  min(sent_at) AS first_message_at, max(sent_at) AS last_message_at,
  (SELECT count(DISTINCT conversation_id) FROM m) AS conversations FROM {ONCE}""")
def conversation_totals(spark, sf):
    rows = stats.conversation_totals(arc.message_facts(archive(spark, sf), KEY))
    return stats.public_times(rows, "first_message_at", "last_message_at")


def _by(bucket: str, label: str, source: str) -> str:
    return f"""SELECT {label} AS {bucket}, count(*) AS messages,
  count(*) FILTER (direction = 'from_me') AS from_me, count(*) FILTER (direction = 'to_me') AS to_me
  FROM {source} GROUP BY 1"""


@query("conversation_by_year", TWICE + _by("year", "substr(sent_at, 1, 4)", ONCE))
def conversation_by_year(spark, sf):
    return stats.conversation_by_year(arc.message_facts(archive(spark, sf), KEY))


@query("conversation_by_day", EV + _by("day", "strftime(sent_at, '%Y-%m-%d')",
       "event_messages WHERE sent_at >= TIMESTAMP '2024-01-05' AND sent_at < TIMESTAMP '2024-01-20'"))
def conversation_by_day(spark, sf):
    return stats.conversation_by_period(
        messages_from_events(spark, sf), "day", since="2024-01-05T00:00:00Z", until="2024-01-20T00:00:00Z"
    )


@query("one_conversation_totals", EV + f"""SELECT count(*) AS messages,
  count(*) FILTER (direction = 'from_me') AS from_me, count(*) FILTER (direction = 'to_me') AS to_me,
  {q.iso('min(sent_at)')} AS first_message_at, {q.iso('max(sent_at)')} AS last_message_at,
  count(DISTINCT conversation_id) AS conversations FROM event_messages WHERE conversation_id = '7'""")
def one_conversation_totals(spark, sf):
    rows = stats.conversation_totals(messages_from_events(spark, sf), conversation_id="7")
    return stats.public_times(rows, "first_message_at", "last_message_at")


@query("direction_share", q.with_(q.TALK_MESSAGES) + """SELECT count(*) FILTER (direction = 'from_me') AS sent_count,
  count(*) FILTER (direction = 'to_me') AS received_count,
  round(count(*) FILTER (direction = 'from_me') * 100.0 / count(*), 6) AS sent_percent,
  round(count(*) FILTER (direction = 'to_me') * 100.0 / count(*), 6) AS received_percent FROM talk_messages""")
def direction_share(spark, sf):
    shares = stats.direction_share(messages_from_conversations(spark, sf))
    return shares.withColumns({c: F.round(c, 6) for c in ("sent_percent", "received_percent")})


@query("messages_read", """SELECT concat('archive_', tool) AS tool, sum(n) AS messages_read FROM (
  SELECT CASE event_type WHEN 'view' THEN 'search_messages' WHEN 'click' THEN 'search_context'
    WHEN 'purchase' THEN 'read_conversation' WHEN 'signup' THEN 'sample_conversation' ELSE 'list_people' END AS tool,
    CASE event_type WHEN 'click' THEN user_id % 9 WHEN 'error' THEN 0 ELSE 1 END AS n FROM events) GROUP BY 1""")
def messages_read(spark, sf):
    results = table(spark, sf, "events").selectExpr(
        "concat('archive_', CASE event_type WHEN 'view' THEN 'search_messages' "
        "WHEN 'click' THEN 'search_context' WHEN 'purchase' THEN 'read_conversation' "
        "WHEN 'signup' THEN 'sample_conversation' ELSE 'list_people' END) AS tool",
        "CAST(user_id % 9 AS INT) AS message_count",
    )
    return stats.messages_read(results)


@query("evidence_tiers", """SELECT CASE WHEN p_size % 7 >= 5 THEN 'broad' WHEN p_size % 7 = 4 THEN 'repeated'
  ELSE 'limited' END AS tier, count(*) AS themes FROM part GROUP BY 1""")
def evidence_tiers(spark, sf):
    themes = table(spark, sf, "part").selectExpr("p_partkey", "p_size % 7 AS evidence_strength")
    return stats.evidence_tiers(themes)


# --- filters ----------------------------------------------------------------

FILTERED = "SELECT conversation_id, message_id, direction FROM event_messages WHERE "


def _three(df):
    return df.select("conversation_id", "message_id", "direction")


@query("filtered_messages", EV + FILTERED + """direction = 'to_me' AND sent_at >= TIMESTAMP '2024-01-03 12:00:00'
  AND sent_at < TIMESTAMP '2024-01-21' AND user_id % 25 IN (3, 4)""")
def filtered_messages(spark, sf):
    return _three(filters.filter_messages(
        messages_from_events(spark, sf), person_ids=["g3", "g4", "g3"], direction="to_me",
        since="2024-01-03T14:00:00+02:00", until="2024-01-21T00:00:00.000Z",
    ))


@query("filtered_messages_all_people", EV + FILTERED + "user_id = 28")
def filtered_messages_all_people(spark, sf):
    rows = messages_from_events(spark, sf)
    return _three(filters.filter_messages(rows, person_ids=["u28", "g3"], person_match="all"))


@query("conversations_with_people", A + """SELECT chat_id FROM chat_handle WHERE handle_id IN (5, 9, 12, 40)
  GROUP BY 1 HAVING count(DISTINCT handle_id) >= 1""")
def conversations_with_people(spark, sf):
    return filters.conversations_with_people(archive(spark, sf)["chat_handle"], [5, 9, 12, 40])


@query("conversations_with_all_people", A + """SELECT a.chat_id FROM chat_handle a JOIN chat_handle b USING (chat_id)
  WHERE a.handle_id = 1 AND b.handle_id = 7 GROUP BY 1""")
def conversations_with_all_people(spark, sf):
    return filters.conversations_with_people(archive(spark, sf)["chat_handle"], [1, 7], "all")


@query("conversations_with_many_people", A + """SELECT chat_id FROM chat_handle WHERE handle_id BETWEEN 1 AND 30
  GROUP BY 1 HAVING count(DISTINCT handle_id) = 30
  UNION ALL SELECT chat_id FROM chat_handle WHERE handle_id = 40""")
def conversations_with_many_people(spark, sf):
    """Thirty people at once, which no conversation has here, next to one."""
    links = archive(spark, sf)["chat_handle"]
    every = filters.conversations_with_people(links, range(1, 31), "all")
    return every.unionAll(filters.conversations_with_people(links, [40]))


# --- reading ----------------------------------------------------------------


@query("read_page", EV + f"""SELECT * FROM (SELECT message_id, {q.iso('sent_at')} AS sent_at, direction, text
  FROM event_messages WHERE conversation_id = '11' AND sent_at < TIMESTAMP '2024-01-25'
  ORDER BY sent_at DESC, message_id DESC LIMIT 20)""")
def read_page(spark, sf):
    page = reading.read_conversation(
        messages_from_events(spark, sf), "11", limit=20, until="2024-01-25T00:00:00Z"
    )
    return stats.public_times(page, "sent_at").select("message_id", "sent_at", "direction", "text")


@query("next_page_cursor", EV + f"""SELECT {q.iso('sent_at')} AS sent_at, message_id FROM (
  SELECT * FROM (SELECT * FROM event_messages WHERE conversation_id = '11'
    ORDER BY sent_at DESC, message_id DESC LIMIT 5) ORDER BY sent_at, message_id LIMIT 1)""")
def next_page_cursor(spark, sf):
    page = reading.read_conversation(messages_from_events(spark, sf), "11", limit=5)
    return stats.public_times(reading.next_cursor(page, 5), "sent_at")


@query("newest_messages", EV + f"""SELECT message_id, {q.iso('sent_at')} AS sent_at FROM event_messages
  ORDER BY sent_at DESC, message_id DESC LIMIT 5000""".replace("{iso}", ""))
def newest_messages(spark, sf):
    rows = reading.newest(messages_from_events(spark, sf), 5_000)
    return stats.public_times(rows, "sent_at").select("message_id", "sent_at")


SAMPLED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sent_at, message_id) AS rn,
  count(*) OVER (PARTITION BY conversation_id) AS n FROM event_messages)"""


@query("sample_evenly", q.with_(q.EVENT_MESSAGES, SAMPLED) + """SELECT conversation_id, message_id, rn AS rank FROM ranked
  WHERE (rn - 1) % greatest(1, n // 20) = 0 AND (rn - 1) // greatest(1, n // 20) < 20""")
def sample_evenly(spark, sf):
    rows = reading.sample_conversations(messages_from_events(spark, sf), limit=20)
    return rows.select("conversation_id", "message_id", "rank")


@query("sample_spread", q.with_(q.EVENT_MESSAGES, SAMPLED) + """SELECT DISTINCT conversation_id, message_id, rn AS rank FROM ranked
  JOIN (SELECT unnest(generate_series(0, 19)) AS k) ON n <= 20 OR rn - 1 = k * n // 20""")
def sample_spread(spark, sf):
    rows = reading.sample_conversations(messages_from_events(spark, sf), limit=20, spread=True)
    return rows.select("conversation_id", "message_id", "rank")


@query("sample_one_conversation", q.with_(q.EVENT_MESSAGES, SAMPLED) + """SELECT message_id, rn AS rank FROM ranked
  WHERE conversation_id = '3' AND (rn - 1) % greatest(1, n // 7) = 0 AND (rn - 1) // greatest(1, n // 7) < 7""")
def sample_one_conversation(spark, sf):
    rows = reading.sample_conversation(messages_from_events(spark, sf), "3", limit=7)
    return rows.select("message_id", "rank")


@query("recent_excerpts", q.with_(*q.ARCHIVE, f"m AS ({NORMALIZED})", """chosen AS (
  SELECT * FROM directory
  WHERE name <> 'Unnamed conversation' AND members = 1 AND participants <> 'Unknown person'
  ORDER BY last_at DESC, conversation_id LIMIT 7)""") + """SELECT m.conversation_id, c.name, message_id, direction, text FROM (
    SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sent_at DESC, message_id DESC) AS place FROM m) m
  JOIN chosen c USING (conversation_id) WHERE place <= 30""")
def recent_excerpts(spark, sf):
    contacts = con.load_contacts(address_books(spark, sf))
    directory = stats.conversation_directory(archive(spark, sf), contacts, KEY)
    chosen = cut_lineage(reading.recent_conversations(directory))
    messages = _normalized(spark, sf, named=False, chats=chosen.select("chat_id"))
    rows = reading.excerpts_of(messages, chosen, n=30)
    return rows.select("conversation_id", "name", "message_id", "direction", "text")


ATTACHED = """attached AS (SELECT message_id, string_agg(name || ' ' || mime_type, ',' ORDER BY name, mime_type) AS files FROM (
  SELECT page_id // 2 AS message_id, '[attachment]' || lower(regexp_extract(
      CASE WHEN page_id % 3 = 0 THEN 'Photo ' || page_id || '.JPG' WHEN page_id % 3 = 2 THEN url END, '\\.[A-Za-z0-9]{1,10}$')) AS name,
    CASE WHEN page_id % 3 = 0 THEN 'image/jpeg' ELSE 'text/html' END AS mime_type FROM pages WHERE page_id % 3 <> 1) GROUP BY 1)"""


@query("read_page_view", A.rstrip() + f",\nm AS ({NORMALIZED}),\n{ATTACHED}\n" + """SELECT m.conversation_id, d.name AS conversation_name, m.message_id,
  m.sent_at, m.direction, m.text, coalesce(a.files, '') AS attachments
  FROM m JOIN directory d USING (conversation_id) LEFT JOIN attached a USING (message_id)""")
def read_page_view(spark, sf):
    """Every message as a caller reads it: with the conversation's name and safe attachment names."""
    raw, contacts = archive(spark, sf), con.load_contacts(address_books(spark, sf))
    rows = _normalized(spark, sf, with_attachments=True)
    names = stats.conversation_directory(raw, contacts, KEY).select(
        "conversation_id", F.col("name").alias("conversation_name")
    )
    named = F.filter("attachments", lambda a: a["name"].isNotNull())
    files = F.transform(named, lambda a: F.concat_ws(" ", a["name"], a["mime_type"]))
    return search.public_messages(rows, names).select(
        "conversation_id", "conversation_name", "message_id", "sent_at", "direction", "text",
        F.array_join(files, ",").alias("attachments"),
    )


@query("loaded_archive", A + """SELECT (SELECT count(*) FROM raw_message) AS messages,
  (SELECT count(*) FROM chat_message) AS links, (SELECT count(*) FROM handle) AS people""")
def loaded_archive(spark, sf):
    """The archive written as files and read back through its loader."""
    path = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    for name, frame in archive(spark, sf).items():
        frame.write.parquet(f"{path}/{name}.parquet")
    raw = arc.load_archive(spark, path)
    counts = [
        filters.real_messages(raw["message"]).agg(F.count("*").alias("messages")),
        raw["chat_message"].agg(F.count("*").alias("links")),
        raw["handle"].agg(F.count("*").alias("people")),
    ]
    return counts[0].withColumn("links", counts[1].scalar()).withColumn("people", counts[2].scalar())
