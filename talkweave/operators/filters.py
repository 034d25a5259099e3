"""Predicates shared by reading, search and tone. Options left out add nothing to the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import iso_argument, time_literal
from ..functions.text import contains_ci

DIRECTIONS = ("from_me", "to_me")


def clamp_limit(value: int | None, low: int, high: int, default: int) -> int:
    """A caller's page size, pulled into what a tool allows."""
    return min(high, max(low, default if value is None else value))


def strict_limit(value: int | None, high: int, default: int) -> int:
    result = default if value is None else value
    if not 1 <= result <= high:
        raise ValueError(f"a limit from 1 to {high} is needed")
    return result


def real_messages(messages: DataFrame) -> DataFrame:
    """Drop the archive's non-message rows (joins, renames, reactions)."""
    return messages.filter(F.col("item_type") == 0)


def in_period(df: DataFrame, column: str, since=None, until=None) -> DataFrame:
    """Half-open period `since <= t < until`; either side may be missing."""
    since, until = iso_argument(since, "since"), iso_argument(until, "until")
    if since is not None:
        df = df.filter(F.col(column) >= time_literal(since))
    if until is not None:
        df = df.filter(F.col(column) < time_literal(until))
    return df


def overlaps_period(df: DataFrame, start: str, end: str, since=None, until=None) -> DataFrame:
    since, until = iso_argument(since, "since"), iso_argument(until, "until")
    if since is not None:
        df = df.filter(F.col(end) >= time_literal(since))
    if until is not None:
        df = df.filter(F.col(start) < time_literal(until))
    return df


def people_match(column: Column, person_ids, person_match: str = "any") -> Column:
    wanted = list(dict.fromkeys(person_ids))
    literal = F.array(*[F.lit(p) for p in wanted])
    if person_match == "all":
        return F.size(F.array_except(literal, column)) == 0
    return F.arrays_overlap(column, literal)


def filter_messages(
    df: DataFrame,
    conversation_id: str | None = None,
    person_ids=(),
    person_match: str = "any",
    since=None,
    until=None,
    direction: str | None = None,
    time: str = "sent_at",
) -> DataFrame:
    if conversation_id is not None:
        df = df.filter(F.col("conversation_id") == conversation_id)
    df = in_period(df, time, since, until)
    if direction in DIRECTIONS:
        df = df.filter(F.col("direction") == direction)
    if person_ids:
        df = df.filter(people_match(F.col("person_ids"), person_ids, person_match))
    return df


def filter_passages(
    df: DataFrame,
    conversation_id: str | None = None,
    person_ids=(),
    person_match: str = "any",
    since=None,
    until=None,
    direction: str | None = None,
) -> DataFrame:
    """As for messages, but a passage only has to overlap the period and contain the direction."""
    if conversation_id is not None:
        df = df.filter(F.col("conversation_id") == conversation_id)
    df = overlaps_period(df, "start_at", "end_at", since, until)
    if direction in DIRECTIONS:
        df = df.filter(F.array_contains("directions", direction))
    if person_ids:
        df = df.filter(people_match(F.col("person_ids"), person_ids, person_match))
    return df


def conversations_with_people(
    chat_handle: DataFrame, handle_ids, person_match: str = "any"
) -> DataFrame:
    """Conversations that have any, or all, of the given participants."""
    wanted = list(dict.fromkeys(handle_ids))
    needed = len(wanted) if person_match == "all" else min(len(wanted), 1)
    return (
        chat_handle.filter(F.col("handle_id").isin(wanted))
        .groupBy("chat_id")
        .agg(F.countDistinct("handle_id").alias("found"))
        .filter(F.col("found") >= needed)
        .select("chat_id")
    )


def any_contains(columns: list[str], needle: str) -> Column:
    test = F.lit(False)
    for column in columns:
        test = test | F.coalesce(contains_ci(F.col(column), needle), F.lit(False))
    return test
