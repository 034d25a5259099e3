"""Passages, turns, exchange windows and their tone."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from ..functions.clock import iso_text
from ..operators import tone
from ..operators.filters import filter_passages
from ..operators.segment import build_exchange_windows, build_passages, build_turns
from ..operators.stats import public_times
from ..sources.driver_tables import messages_from_conversations, messages_from_events, table
from . import sql as q
from .catalog import query

GAP = 21_600


def counting_scorer(texts: list[str]) -> np.ndarray:
    """A stand-in classifier: it counts two letter pairs. It measures nothing."""
    return np.array([[0.1 * t.count("th"), 1.0, 0.1 * t.count("er")] for t in texts])


def _passages_sql(source: str) -> str:
    return q.with_(q.EVENT_MESSAGES, q.TALK_MESSAGES, f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY message_id) - 1 AS r FROM {source})""",
        """placed AS (SELECT *, r // 512 AS page, r % 512 AS pos FROM ranked)""",
        """pages AS (SELECT conversation_id, page, count(*) AS n FROM placed GROUP BY 1, 2)""",
        """starts AS (SELECT conversation_id, page, unnest(generate_series(0, n - 1, 6)) AS s FROM pages)""",
        f"""built AS (SELECT conversation_id, min(message_id) AS start_message_id, max(message_id) AS end_message_id,
    min(sent_at) AS start_at, max(sent_at) AS end_at, count(*) AS message_count,
    array_to_string(list_sort(list(DISTINCT direction)), ',') AS directions,
    string_agg(CASE WHEN trim(text) <> '' THEN {q.iso('sent_at')} || ' · ' ||
      CASE WHEN direction = 'from_me' THEN 'You' ELSE 'Contact' END || ': ' || trim(text) END, chr(10) ORDER BY message_id) AS text
  FROM starts JOIN placed USING (conversation_id, page) WHERE pos BETWEEN s AND s + 7
  GROUP BY conversation_id, page, s)""")


SHOWN = f"""SELECT conversation_id, start_message_id, end_message_id, {q.iso('start_at')} AS start_at,
  {q.iso('end_at')} AS end_at, message_count, directions, text FROM built"""


def _shown(df):
    return public_times(df, "start_at", "end_at").select(
        "conversation_id", "start_message_id", "end_message_id", "start_at", "end_at",
        "message_count", F.array_join("directions", ",").alias("directions"), "text",
    )


@query("passages", _passages_sql("event_messages") + SHOWN)
def passages(spark, sf):
    return _shown(build_passages(messages_from_events(spark, sf)))


@query("talk_passages", _passages_sql("talk_messages") + SHOWN)
def talk_passages(spark, sf):
    return _shown(build_passages(messages_from_conversations(spark, sf)))


@query("filtered_passages", _passages_sql("event_messages") + SHOWN + """
  WHERE end_at >= TIMESTAMP '2024-01-10' AND start_at < TIMESTAMP '2024-01-12' AND directions LIKE '%from_me%' AND conversation_id = '5'""")
def filtered_passages(spark, sf):
    return _shown(filter_passages(
        build_passages(messages_from_events(spark, sf)), conversation_id="5",
        since="2024-01-10T00:00:00Z", until="2024-01-12T00:00:00Z", direction="from_me",
    ))


EVENT_TURNS = q.with_(q.EVENT_MESSAGES, q.turns("t", "event_messages", GAP), recursive=True)
TALK_TURNS = q.with_(q.TALK_MESSAGES, q.turns("t", "talk_messages", 120), q.windows("w", "t"), recursive=True)
TURN_COLUMNS = f"""SELECT conversation_id, turn_no, start_message_id, end_message_id, {q.iso('start_at')} AS start_at,
  {q.iso('end_at')} AS end_at, direction, speaker, message_count, text FROM t"""


def _turns(df):
    return public_times(df, "start_at", "end_at").select(
        "conversation_id", "turn_no", "start_message_id", "end_message_id", "start_at", "end_at",
        "direction", "speaker", "message_count", "text",
    )


@query("turns", EVENT_TURNS + TURN_COLUMNS)
def turns(spark, sf):
    return _turns(build_turns(messages_from_events(spark, sf), gap_seconds=GAP))


@query("small_turns", q.with_(q.EVENT_MESSAGES, q.turns("t", "event_messages", 10 * GAP, 2, 60), recursive=True) + TURN_COLUMNS)
def small_turns(spark, sf):
    """Tight caps, so that the caps rather than the gaps end most turns."""
    return _turns(build_turns(
        messages_from_events(spark, sf), gap_seconds=10 * GAP, max_messages=2, max_chars=60
    ))


@query("turns_across_slots", EVENT_TURNS + TURN_COLUMNS)
def turns_across_slots(spark, sf):
    """Slots and pieces so small that most turns cross one."""
    rows = messages_from_events(spark, sf)
    return _turns(build_turns(rows, gap_seconds=GAP, bits=4, piece_rows=32))


@query("talk_turns", TALK_TURNS + TURN_COLUMNS)
def talk_turns(spark, sf):
    return _turns(build_turns(messages_from_conversations(spark, sf)))


WINDOW_COLUMNS = f"""SELECT conversation_id, start_message_id, end_message_id, {q.iso('start_at')} AS start_at,
  {q.iso('end_at')} AS end_at, turn_count, directions, text FROM w"""


def _windows(df):
    return public_times(df, "start_at", "end_at").select(
        "conversation_id", "start_message_id", "end_message_id", "start_at", "end_at", "turn_count",
        F.array_join("directions", ",").alias("directions"), "text",
    )


@query("exchange_windows", q.with_(q.EVENT_MESSAGES, q.turns("t", "event_messages", GAP), q.windows("w", "t"), recursive=True) + WINDOW_COLUMNS)
def exchange_windows(spark, sf):
    return _windows(build_exchange_windows(build_turns(messages_from_events(spark, sf), gap_seconds=GAP)))


@query("talk_windows", TALK_TURNS + WINDOW_COLUMNS)
def talk_windows(spark, sf):
    return _windows(build_exchange_windows(build_turns(messages_from_conversations(spark, sf))))


# --- tone -------------------------------------------------------------------


def _scored_turns(spark, sf):
    turns = build_turns(messages_from_conversations(spark, sf), numbered=False)
    return tone.score_tone(turns, counting_scorer)


def _scored_windows(spark, sf):
    windows = build_exchange_windows(build_turns(messages_from_conversations(spark, sf)))
    return tone.score_tone(windows, counting_scorer)


TONE = q.with_(q.TALK_MESSAGES, q.turns("t", "talk_messages", 120), q.windows("w", "t"),
               q.scored("st", "t"), q.scored("sw", "w"), recursive=True)


@query("scored_turns", TONE + """SELECT conversation_id, start_message_id, round(negative, 4) AS negative, round(neutral, 4) AS neutral,
  round(positive, 4) AS positive, round(valence, 4) AS valence, round(confidence, 4) AS confidence FROM st""")
def scored_turns(spark, sf):
    rows = _scored_turns(spark, sf)
    return rows.select(
        "conversation_id", "start_message_id", *[F.round(c, 4).alias(c) for c in tone.SCORES]
    )


@query("tone_summary", TONE + f"SELECT {q.AGGREGATES} FROM st")
def tone_summary(spark, sf):
    return tone.tone_summary(_scored_turns(spark, sf))


@query("tone_by_direction", TONE + f"SELECT direction, {q.AGGREGATES} FROM st GROUP BY 1")
def tone_by_direction(spark, sf):
    return tone.tone_summary(_scored_turns(spark, sf), by=("direction",))


@query("tone_of_windows", TONE + f"SELECT {q.AGGREGATES} FROM sw")
def tone_of_windows(spark, sf):
    return tone.tone_summary(_scored_windows(spark, sf))


@query("tone_in_period", TONE + f"SELECT {q.AGGREGATES} FROM st WHERE start_at >= TIMESTAMP '2024-02-01' AND start_at < TIMESTAMP '2024-03-01'")
def tone_in_period(spark, sf):
    return tone.tone_summary(
        _scored_turns(spark, sf), since="2024-02-01T00:00:00Z", until="2024-03-01T00:00:00Z"
    )


TALK_PEOPLE = """(SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 'p' || (conv_id % 7) AS p, 'q' || (conv_id % 3) AS q
  FROM conversations GROUP BY conv_id)"""


def _talk_people(spark, sf):
    return table(spark, sf, "conversations").select("conv_id").distinct().selectExpr(
        "CAST(conv_id AS STRING) AS conversation_id",
        "array(concat('p', conv_id % 7), concat('q', conv_id % 3)) AS person_ids",
    )


@query("tone_for_people_any", TONE + f"SELECT {q.AGGREGATES} FROM st JOIN {TALK_PEOPLE} USING (conversation_id) WHERE p = 'p2' OR q = 'q1'")
def tone_for_people_any(spark, sf):
    return tone.tone_summary(
        _scored_turns(spark, sf), people=_talk_people(spark, sf), person_ids=["p2", "q1"]
    )


@query("tone_for_people_all", TONE + f"SELECT {q.AGGREGATES} FROM st JOIN {TALK_PEOPLE} USING (conversation_id) WHERE p = 'p2' AND q = 'q1'")
def tone_for_people_all(spark, sf):
    return tone.tone_summary(
        _scored_turns(spark, sf), people=_talk_people(spark, sf), person_ids=["p2", "q1"],
        person_match="all",
    )


@query("tone_of_windows_for_people", TONE + f"""SELECT {q.AGGREGATES} FROM sw JOIN {TALK_PEOPLE} USING (conversation_id)
  WHERE (p = 'p2' OR q = 'q1') AND directions LIKE '%from_me%'""")
def tone_of_windows_for_people(spark, sf):
    return tone.tone_summary(
        _scored_windows(spark, sf), people=_talk_people(spark, sf), person_ids=["p2", "q1"],
        direction="from_me",
    )


def _timeline(label: str) -> str:
    return TONE + f"SELECT {label} AS period, {q.AGGREGATES} FROM st GROUP BY 1"


@query("tone_timeline", _timeline("strftime(start_at, '%Y-%m')"))
def tone_timeline(spark, sf):
    return tone.tone_timeline(_scored_turns(spark, sf))


@query("tone_timeline_by_quarter", _timeline("strftime(start_at, '%Y') || '-Q' || quarter(start_at)"))
def tone_timeline_by_quarter(spark, sf):
    return tone.tone_timeline(_scored_turns(spark, sf), "quarter")


@query("tone_timeline_by_year", _timeline("strftime(start_at, '%Y')"))
def tone_timeline_by_year(spark, sf):
    return tone.tone_timeline(_scored_turns(spark, sf), "year")


def _trend(series: str, label: str, where: str, current: str) -> str:
    return f"""SELECT '{series}' AS series, {label} AS period, {q.AGGREGATES}, {label} = '{current}' AS partial
  FROM st {where} GROUP BY 2"""


@query("tone_trends", TONE + f"""SELECT series, period, "count", positive_share AS positive, neutral_share AS neutral,
  negative_share AS negative, valence AS net, partial FROM (
  {_trend('yearly', "strftime(start_at, '%Y')", '', '2024')}
  UNION ALL {_trend('recent', "strftime(start_at, '%Y-%m')", "WHERE start_at >= TIMESTAMP '2023-05-01'", '2024-04')})""")
def tone_trends(spark, sf):
    return tone.tone_trends(_scored_turns(spark, sf), dt.date(2024, 4, 5))


HALF = "CASE WHEN start_message_id % 2 = 0 THEN positive END"


@query("tone_coverage", TONE + f"""SELECT count(*) AS total, count(p) AS analyzed, round(count(p) * 100.0 / count(*), 4) AS coverage_percent
  FROM (SELECT {HALF} AS p FROM st UNION ALL SELECT positive FROM sw)""")
def tone_coverage(spark, sf):
    turns = _scored_turns(spark, sf).withColumn("positive", F.expr(HALF))
    return tone.tone_coverage(turns, _scored_windows(spark, sf))


@query("pending_tone", TONE + f"""SELECT kind, conversation_id, start_message_id, {q.iso('end_at')} AS end_at FROM (
  SELECT 'turn' AS kind, conversation_id, start_message_id, end_at FROM st WHERE start_message_id % 2 = 1
  UNION ALL SELECT 'window', conversation_id, start_message_id, end_at FROM sw)
  ORDER BY {'end_at'} DESC, start_message_id DESC, conversation_id, kind LIMIT 80""".replace(
      f"SELECT kind, conversation_id, start_message_id, {q.iso('end_at')} AS end_at FROM (",
      f"SELECT kind, conversation_id, start_message_id, {q.iso('end_at')} AS ended FROM ("))
def pending_tone(spark, sf):
    turns = _scored_turns(spark, sf).withColumn("positive", F.expr(HALF))
    windows = build_exchange_windows(build_turns(messages_from_conversations(spark, sf)))
    queue = tone.pending_tone(turns, windows.withColumn("positive", F.lit(None).cast("double")))
    return queue.select(
        "kind", "conversation_id", "start_message_id", iso_text(F.col("end_at")).alias("ended")
    )
