"""Calendar queries."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import iso_argument
from ..functions.identity import CALENDAR_ID_CHARS, opaque_id
from .filters import any_contains, overlaps_period, strict_limit

# Defaults and limits of the calendar views.
SEARCHED = ["title", "calendar", "location", "notes"]
PREVIEW_CHARS, NOTES_CHARS, MAX_EVENTS = 280, 10_000, 100


def _calendar_source(events: DataFrame) -> Column:
    return F.coalesce("calendar_id", "calendar", F.lit("calendar"))


def calendar_opaque(events: DataFrame, key: bytes) -> Column:
    return opaque_id("calendar", _calendar_source(events), key, CALENDAR_ID_CHARS)


def event_opaque(key: bytes) -> Column:
    return opaque_id("event", F.coalesce("source_id", F.lit("event")), key, CALENDAR_ID_CHARS)


def calendar_info(events: DataFrame, key: bytes) -> DataFrame:
    """Events per calendar by name, with the total and the covered range on every row."""
    source = _calendar_source(events)
    counted = events.groupBy(source.alias("source")).agg(
        F.min(F.coalesce("calendar", F.lit("Calendar"))).alias("name"),
        F.count("*").alias("event_count"),
        F.min("start_at").alias("first_start"),
        F.max("end_at").alias("last_end"),
    )
    # One row per calendar is left: the total is a sum of these.
    total = F.sum("event_count").over(Window.partitionBy())
    return counted.select(
        opaque_id("calendar", F.col("source"), key, CALENDAR_ID_CHARS).alias("calendar_id"),
        "name",
        "event_count",
        "first_start",
        "last_end",
        total.alias("total_events"),
    ).orderBy("name", "calendar_id")


def calendar_event_view(
    events: DataFrame, key: bytes, full: bool = False, chars: int | None = None
) -> DataFrame:
    """Events as shown to callers, with defaults; `chars` cuts the notes."""
    name = "notes" if full else "notes_preview"
    notes = F.col("notes") if chars is None else F.substring("notes", 1, chars)
    return events.select(
        event_opaque(key).alias("event_id"),
        F.coalesce("title", F.lit("Untitled event")).alias("title"),
        "start_at",
        "end_at",
        F.coalesce("is_all_day", F.lit(False)).alias("is_all_day"),
        calendar_opaque(events, key).alias("calendar_id"),
        F.coalesce("calendar", F.lit("Calendar")).alias("calendar"),
        "location",
        F.coalesce("status", F.lit("none")).alias("status"),
        F.coalesce("availability", F.lit("not_supported")).alias("availability"),
        notes.alias(name),
    )


def matching_events(
    events: DataFrame, key: bytes, query: str | None = None, calendar_ids=(), since=None,
    until=None, now: datetime | None = None,
) -> DataFrame:
    """Events that overlap the period and contain the query in any text field.

    Without any condition the period is the year that starts today.
    """
    needle = (query or "").strip()
    since, until = iso_argument(since, "since"), iso_argument(until, "until")
    if since is not None and until is not None and until <= since:
        raise ValueError("a period ends after it starts")
    if not needle and since is None and until is None:
        now = now or datetime.now(timezone.utc).replace(tzinfo=None)
        since = now.replace(hour=0, minute=0, second=0, microsecond=0)
        try:
            until = since.replace(year=since.year + 1)
        except ValueError:
            until = since + timedelta(days=365)
    rows = events.filter(F.col("start_at").isNotNull() & F.col("end_at").isNotNull())
    rows = overlaps_period(rows, "start_at", "end_at", since, until)
    if needle:
        rows = rows.filter(any_contains(SEARCHED, needle))
    if calendar_ids:
        rows = rows.filter(calendar_opaque(rows, key).isin(list(calendar_ids)))
    return rows


def search_calendar_events(
    events: DataFrame, key: bytes, query: str | None = None, calendar_ids=(), since=None,
    until=None, limit: int | None = None, now: datetime | None = None, chars: int | None = None,
) -> DataFrame:
    """The matching events by start, the first `limit` if given, with the number of all on every row."""
    limit = None if limit is None else strict_limit(limit, 1_000, 100)
    matches = matching_events(events, key, query, calendar_ids, since, until, now)
    total = matches.agg(F.count("*").alias("n")).scalar()
    page = matches if limit is None else matches.orderBy("start_at", "source_id").limit(limit)
    returned = F.col("total_matches") if limit is None else F.least(F.col("total_matches"), F.lit(limit))
    return (
        calendar_event_view(page, key, chars=chars)
        .withColumn("total_matches", total)
        .withColumn("returned", returned)
        .orderBy("start_at", "event_id")
    )


def read_calendar_events(
    events: DataFrame, key: bytes, event_ids: list[str], chars: int | None = None
) -> DataFrame:
    """Full details of up to 100 events, with how many were asked for and found."""
    if not 1 <= len(event_ids) <= MAX_EVENTS:
        raise ValueError(f"ask for 1 to {MAX_EVENTS} events at a time")
    wanted = list(dict.fromkeys(event_ids))
    rows = events.filter(F.col("source_id").isNotNull() & event_opaque(key).isin(wanted))
    found = rows.agg(F.count("*").alias("n")).scalar()
    return calendar_event_view(rows, key, full=True, chars=chars).withColumns(
        {"requested": F.lit(len(wanted)), "found": found}
    )
