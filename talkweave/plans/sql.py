"""The benchmark archive in DuckDB SQL, and small SQL builders for the comparison queries."""

from __future__ import annotations

import base64
import hmac

from ..sources.driver_tables import GROUP_CHAT, KEY


def with_(*tables: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(tables) + "\n"


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def _blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


def opaque(namespace: str, expr: str, n: int = 18, key: bytes = KEY) -> str:
    padded = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in padded) for pad in (0x36, 0x5C))
    message = f"encode('{namespace}:' || CAST({expr} AS VARCHAR))"
    digest = f"sha256({_blob(outer)} || unhex(sha256({_blob(inner)} || {message})))"
    text = f"translate(to_base64(unhex({digest})), '+/=', '-_')"
    return f"('{namespace}_' || substr({text}, 1, {n}))"


EVENT_MESSAGES = """event_messages AS (
  SELECT CAST(user_id AS VARCHAR) AS conversation_id, event_id AS message_id, ts AS sent_at,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'from_me' ELSE 'to_me' END AS direction,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'me' ELSE event_type END AS speaker,
    concat(event_type, ' ', props) AS text, user_id
  FROM events)"""

TALK_MESSAGES = """talk_messages AS (
  SELECT CAST(conv_id AS VARCHAR) AS conversation_id, conv_id * 1000 + turn AS message_id,
    TIMESTAMP '2024-01-01' + to_days(CAST(conv_id AS INT)) + to_seconds(turn * 90) AS sent_at,
    CASE WHEN role = 'user' THEN 'from_me' ELSE 'to_me' END AS direction,
    CASE WHEN role = 'user' THEN 'me' ELSE 'contact' END AS speaker, text
  FROM conversations WHERE role IN ('user', 'assistant'))"""

DOCUMENT_PASSAGES = """passages AS (
  SELECT d.doc_id AS passage_id, d.source AS conversation_id, d.lang,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id AS INT)) AS start_at,
    TIMESTAMP '2024-01-01 02:00:00' + to_hours(CAST(d.doc_id AS INT)) AS end_at,
    CASE WHEN d.doc_id % 2 = 0 THEN 'from_me' ELSE 'to_me' END AS direction,
    d.text, e.embedding
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""

THREADS = """threads AS (
  SELECT CAST(conv_id AS VARCHAR) AS thread_id, conv_id * 1000 + turn AS id, role,
    text AS content,
    CASE WHEN role = 'user' AND turn >= 4 THEN 'sending' ELSE 'delivered' END AS delivery_status,
    TIMESTAMP '2024-01-01' + to_days(CAST(conv_id AS INT)) + to_seconds(turn * 90) AS created_at
  FROM conversations WHERE role IN ('user', 'assistant'))"""

CALENDAR = """cal AS (
  SELECT CAST(event_id AS VARCHAR) AS source_id, event_type AS calendar_id,
    event_type AS calendar, concat(event_type, '-', user_id) AS title, ts AS start_at,
    ts + to_minutes(CAST(floor(value) AS INT)) AS end_at, user_id % 5 = 0 AS is_all_day,
    CASE WHEN user_id % 3 = 0 THEN concat('Room ', user_id) END AS location, props AS notes,
    CASE WHEN user_id % 4 = 0 THEN 'confirmed' END AS status
  FROM events)"""

RAW_MESSAGE = """raw_message AS (
  SELECT event_id AS rowid,
    CASE WHEN event_type <> 'view' THEN concat(event_type, ' ', props)
         ELSE concat('decoded ', props) END AS text,
    CASE WHEN event_id % 10 = 0 THEN concat('Re: ', event_type) END AS subject,
    event_type IN ('purchase', 'click') AS is_from_me,
    CASE WHEN user_id % 2 = 0 THEN 'chat' ELSE 'sms' END AS service,
    event_id % 7 = 0 AS is_reply, user_id + 1 AS handle_id,
    CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE date_trunc('second', ts) END AS sent_at
  FROM events WHERE event_type <> 'error')"""

RAW_CHAT_MEMBER = f"""members AS (
  SELECT c_custkey, {GROUP_CHAT} + c_custkey // 100 * 25 + c_nationkey AS chat_id FROM customer)"""

RAW_CHAT = """raw_chat AS (
  SELECT DISTINCT user_id + 1 AS chat_id,
    CASE WHEN user_id % 8 = 0 THEN concat('Team ', user_id) END AS safe_name,
    CASE WHEN user_id % 8 = 0 THEN concat('Team ', user_id)
         WHEN user_id % 8 = 4 THEN concat('call 1555', lpad(CAST(user_id AS VARCHAR), 7, '0')) END AS display_name,
    concat('chat', user_id) AS chat_identifier, 'chat' AS service_name, user_id % 5 = 0 AS archived
  FROM events
  UNION ALL
  SELECT chat_id, NULL, NULL, concat('group', min(c_custkey)), 'sms', FALSE FROM members GROUP BY chat_id)"""

RAW_CHAT_MESSAGE = """chat_message AS (
  SELECT user_id + 1 AS chat_id, event_id AS message_id FROM events
  UNION ALL
  SELECT m.chat_id, e.event_id FROM events e JOIN members m ON m.c_custkey = e.user_id
  WHERE e.event_type = 'purchase')"""

RAW_CHAT_HANDLE = """chat_handle AS (
  SELECT DISTINCT user_id + 1 AS chat_id, user_id + 1 AS handle_id FROM events
  UNION ALL SELECT chat_id, c_custkey + 1 FROM members)"""

RAW_HANDLE = """handle AS (
  SELECT c_custkey + 1 AS handle_id, c_custkey,
    CASE WHEN c_custkey % 2 = 0 THEN concat('+1 (555) ', lpad(CAST(c_custkey AS VARCHAR), 7, '0'))
         ELSE concat('customer', c_custkey, '@example.com') END AS identifier
  FROM customer)"""

# What the two address books say about each customer once the first source wins.
PROFILES = """profiles AS (
  SELECT c_custkey,
    CASE WHEN c_custkey % 2 = 0 THEN concat('1555', lpad(CAST(c_custkey AS VARCHAR), 7, '0'))
         ELSE concat('customer', c_custkey, '@example.com') END AS identifier_key,
    CASE WHEN c_custkey % 3 = 0 THEN concat('Firm ', c_custkey)
         WHEN c_custkey % 7 <> 0 THEN concat(upper(c_mktsegment[1]), lower(c_mktsegment[2:]), ' C', c_custkey)
         WHEN c_custkey % 5 <> 0 THEN concat('Nick', c_custkey)
         ELSE concat('Org ', c_nationkey) END AS name,
    CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN concat('Nick', c_custkey) END AS nickname,
    CASE WHEN c_custkey % 3 = 0 THEN concat('Firm ', c_custkey) ELSE concat('Org ', c_nationkey) END AS company,
    CASE WHEN c_custkey % 3 = 0 THEN NULL
         WHEN c_custkey % 11 = 0 THEN concat('reach me at c', c_custkey, '@example.com')
         ELSE 'Buyer' END AS job_title,
    CASE WHEN c_custkey % 3 = 0 THEN concat('Dept ', c_nationkey) END AS department
  FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0)"""

PEOPLE = f"""people AS (
  SELECT h.handle_id, h.identifier, {opaque('person', 'h.identifier')} AS person_id,
    coalesce(p.name, 'Unknown person') AS name,
    CASE WHEN p.nickname <> p.name THEN p.nickname END AS nickname, p.company,
    CASE WHEN p.job_title = 'Buyer' THEN p.job_title END AS job_title, p.department
  FROM handle h LEFT JOIN profiles p USING (c_custkey))"""

LAST_DATES = """last_dates AS (
  SELECT cm.chat_id, max(m.sent_at) AS last_at
  FROM chat_message cm JOIN raw_message m ON m.rowid = cm.message_id GROUP BY 1)"""

DIRECTORY = f"""directory AS (
  SELECT c.chat_id, {opaque('conv', 'c.chat_id')} AS conversation_id,
    coalesce(c.safe_name, w.known, 'Unnamed conversation') AS name,
    coalesce(w.names, '') AS participants, coalesce(w.members, 0) AS members, w.profiles,
    c.display_name, c.chat_identifier, c.service_name AS service, c.archived, l.last_at
  FROM raw_chat c LEFT JOIN last_dates l USING (chat_id)
  LEFT JOIN (
    SELECT ch.chat_id, string_agg(p.name, ', ' ORDER BY p.handle_id) AS names,
      string_agg(p.name, ', ' ORDER BY p.handle_id) FILTER (p.name <> 'Unknown person') AS known,
      string_agg(lower(concat_ws(chr(10), p.name, p.nickname, p.company, p.job_title, p.department)), chr(11)) AS profiles,
      count(*) AS members
    FROM chat_handle ch JOIN people p USING (handle_id) GROUP BY 1) w USING (chat_id))"""

ARCHIVE = (
    RAW_MESSAGE, RAW_CHAT_MEMBER, RAW_CHAT, RAW_CHAT_MESSAGE, RAW_CHAT_HANDLE, RAW_HANDLE,
    PROFILES, PEOPLE, LAST_DATES, DIRECTORY,
)

SCORES = """(
  SELECT *, exp(l1 - top) / (exp(l1 - top) + exp(l2 - top) + exp(l3 - top)) AS negative,
    exp(l2 - top) / (exp(l1 - top) + exp(l2 - top) + exp(l3 - top)) AS neutral,
    exp(l3 - top) / (exp(l1 - top) + exp(l2 - top) + exp(l3 - top)) AS positive
  FROM (SELECT *, greatest(l1, l2, l3) AS top FROM (
    SELECT *, 0.1 * (length(text) - length(replace(text, 'th', ''))) / 2.0 AS l1, 1.0::DOUBLE AS l2,
      0.1 * (length(text) - length(replace(text, 'er', ''))) / 2.0 AS l3
    FROM {source})))"""


def scored(name: str, source: str) -> str:
    inner = SCORES.replace("{source}", source)
    return f"""{name} AS (
  SELECT *, positive - negative AS valence, greatest(negative, neutral, positive) AS confidence
  FROM {inner})"""


AGGREGATES = """count(*) AS "count",
  round(coalesce(avg(negative), 0), 4) AS negative, round(coalesce(avg(neutral), 0), 4) AS neutral,
  round(coalesce(avg(positive), 0), 4) AS positive, round(coalesce(avg(valence), 0), 4) AS valence,
  round(coalesce(avg(confidence), 0), 4) AS confidence,
  round(coalesce(avg(CASE WHEN negative >= neutral AND negative >= positive THEN 1.0 ELSE 0.0 END), 0), 4) AS negative_share,
  round(coalesce(avg(CASE WHEN neutral > negative AND neutral >= positive THEN 1.0 ELSE 0.0 END), 0), 4) AS neutral_share,
  round(coalesce(avg(CASE WHEN positive > negative AND positive > neutral THEN 1.0 ELSE 0.0 END), 0), 4) AS positive_share"""


def turns(name: str, source: str, gap: int, max_messages: int = 20, max_chars: int = 2000) -> str:
    """A greedy walk over each conversation, one message per recursion step."""
    return f"""{name}_rows AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY message_id) AS rn
  FROM {source} WHERE trim(text) <> ''),
{name}_walk AS (
  SELECT conversation_id, rn, message_id, message_id AS first_id, sent_at, speaker,
    1 AS n, least(length(text), {max_chars}) AS chars
  FROM {name}_rows WHERE rn = 1
  UNION ALL
  SELECT r.conversation_id, r.rn, r.message_id,
    CASE WHEN {_joins(gap, max_messages, max_chars)} THEN w.first_id ELSE r.message_id END,
    r.sent_at, r.speaker,
    CASE WHEN {_joins(gap, max_messages, max_chars)} THEN w.n + 1 ELSE 1 END,
    CASE WHEN {_joins(gap, max_messages, max_chars)} THEN w.chars + 1 + length(r.text)
         ELSE least(length(r.text), {max_chars}) END
  FROM {name}_walk w JOIN {name}_rows r ON r.conversation_id = w.conversation_id AND r.rn = w.rn + 1),
{name} AS (
  SELECT w.conversation_id, w.first_id AS start_message_id, max(w.message_id) AS end_message_id,
    min(w.sent_at) AS start_at, max(w.sent_at) AS end_at, min(r.direction) AS direction,
    min(w.speaker) AS speaker, count(*) AS message_count,
    string_agg(trim(r.text), chr(10) ORDER BY w.message_id) AS text,
    row_number() OVER (PARTITION BY w.conversation_id ORDER BY w.first_id) AS turn_no
  FROM {name}_walk w JOIN {name}_rows r USING (conversation_id, rn)
  GROUP BY w.conversation_id, w.first_id)"""


def _joins(gap: int, max_messages: int, max_chars: int) -> str:
    return (
        f"(r.speaker = w.speaker AND w.n < {max_messages} "
        f"AND w.chars + length(r.text) + 1 <= {max_chars} "
        f"AND r.sent_at >= w.sent_at AND r.sent_at <= w.sent_at + to_seconds({gap}))"
    )


def windows(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT g.conversation_id, min(t.start_message_id) AS start_message_id,
    max(t.end_message_id) AS end_message_id, min(t.start_at) AS start_at, max(t.end_at) AS end_at,
    count(*) AS turn_count, array_to_string(list_sort(list(DISTINCT t.direction)), ',') AS directions,
    string_agg(t.text, chr(10) ORDER BY t.turn_no) AS text
  FROM (SELECT conversation_id, turn_no - 1 AS at FROM {source} WHERE (turn_no - 1) % 4 = 0) g
  JOIN {source} t ON t.conversation_id = g.conversation_id AND t.turn_no - 1 BETWEEN g.at AND g.at + 4
  GROUP BY g.conversation_id, g.at
  HAVING count(*) >= 3 AND count(DISTINCT t.speaker) >= 2)"""


def opaque_value(namespace: str, value, n: int = 18, key: bytes = KEY) -> str:
    """An opaque id as a caller holds it."""
    digest = hmac.digest(key, f"{namespace}:{value}".encode(), "sha256")
    return f"{namespace}_{base64.urlsafe_b64encode(digest).decode().rstrip('=')[:n]}"
