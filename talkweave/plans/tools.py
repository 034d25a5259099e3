"""The twelve read-only tools, as lazy frames with everything personal redacted at the edge."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.redaction import redact_frame, redaction_summary
from ..operators import agenda, reading, search, stats, tone
from ..operators.filters import clamp_limit, filter_messages, strict_limit


# What a caller of the tools may ask for at once.
PEOPLE, WORDS = 25, 32


def _few_people(filters: dict) -> dict:
    """Distinct people; more than a tool takes are refused, as leaving some out would change the answer."""
    if filters.get("person_ids"):
        filters = {**filters, "person_ids": list(dict.fromkeys(filters["person_ids"]))}
        if len(filters["person_ids"]) > PEOPLE:
            raise ValueError(f"name at most {PEOPLE} people at a time")
    return filters


def _few_words(query: str) -> list[str]:
    words = search.query_tokens(query)
    if len(words) > WORDS:
        raise ValueError(f"a search takes at most {WORDS} different words")
    return words


@dataclass(frozen=True)
class Answer:
    """Named frames before redaction; `shown` is what callers get."""

    raw: dict[str, DataFrame]

    @cached_property
    def shown(self) -> dict[str, DataFrame]:
        return {name: redact_frame(df) for name, df in self.raw.items()}

    def privacy_redactions(self) -> DataFrame:
        """One row: how many redactions the answer needed, and their sorted categories."""
        parts = [redaction_summary(df) for df in self.raw.values()]
        every = reduce(DataFrame.unionByName, parts)
        return every.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
            F.array_sort(F.collect_set("category")).alias("categories"),
        )


@dataclass
class Toolbox:
    """Frames the tools read. `messages`, `passages`, `turns`, ... are stored tables.

    raw_messages: messages before redaction, which a scan for a substring needs.
    embed: turns a query into a vector; without it only words are searched.
    """

    key: bytes
    archive: dict[str, DataFrame] = field(default_factory=dict)
    contacts: DataFrame | None = None
    messages: DataFrame | None = None
    names: DataFrame | None = None
    message_index: tuple[DataFrame, DataFrame] | None = None
    passages: DataFrame | None = None
    passage_index: tuple[DataFrame, DataFrame] | None = None
    turns: DataFrame | None = None
    windows: DataFrame | None = None
    events: DataFrame | None = None
    embed: Callable[[str], Sequence[float]] | None = None
    raw_messages: DataFrame | None = None

    def database_info(self) -> Answer:
        return Answer({"items": stats.database_info(self.archive)})

    def list_conversations(self, query: str | None = None, limit: int | None = None) -> Answer:
        limit = clamp_limit(limit, 1, 100, 25)
        rows = stats.list_conversations(self.archive, self.contacts, self.key, query, limit)
        return Answer({"conversations": stats.public_times(rows, "last_message_at")})

    def list_people(self, query: str | None = None, limit: int | None = None) -> Answer:
        limit = clamp_limit(limit, 1, 200, 50)
        rows = stats.list_people(self.archive, self.contacts, self.key, query, limit)
        return Answer({"people": stats.public_times(rows, "last_message_at")})

    def read_conversation(
        self, conversation_id: str, limit: int | None = None, before: tuple | None = None,
        since=None, until=None,
    ) -> Answer:
        limit = clamp_limit(limit, 1, 10_000, 100)
        page = reading.read_conversation(
            self.messages, conversation_id, limit, before, since, until
        )
        cursor = reading.next_cursor(page, limit)
        return Answer({
            "messages": search.public_messages(page, self.names),
            "next": stats.public_times(cursor, "sent_at"),
        })

    def search_messages(self, query: str, limit: int | None = None, **filters) -> Answer:
        """Words through the index when there is one, else a scan of the texts as stored."""
        limit = clamp_limit(limit, 1, 5_000, 50)
        filters = _few_people(filters)
        if self.message_index is not None and _few_words(query):
            found = search.search_messages(self.messages, self.message_index[0], query, limit, **filters)
        else:
            stored = self.messages if self.raw_messages is None else self.raw_messages
            found = search.scan_messages(stored, query, limit, **filters)
        return Answer({"messages": search.public_messages(found, self.names)})

    def search_context(self, query: str, limit: int | None = None, **filters) -> Answer:
        vector = self.embed(query) if self.embed else None
        limit = clamp_limit(limit, 1, 200, 30)
        rows = search.search_context(
            self.passages, *self.passage_index, query, vector, limit,
            pool=min(800, 5 * limit), **_few_people(filters),
        )
        coverage = search.search_coverage(self.passages)
        answer = {
            "passages": search.public_passages(rows, self.names),
            "coverage": stats.public_times(coverage, "fully_covered_after"),
        }
        if self.message_index is not None:
            answer["indexed"] = self.message_index[1].agg(F.count("*").alias("indexed_messages"))
        return Answer(answer)

    def tone_analysis(self, bucket: str = "month", **filters) -> Answer:
        filters = _few_people(filters)
        if filters.get("person_ids"):
            filters["people"] = self.messages.groupBy("conversation_id").agg(
                F.first("person_ids", ignorenulls=True).alias("person_ids")
            )
        return Answer({
            "overall": tone.tone_summary(self.turns, **filters),
            "by_direction": tone.tone_summary(self.turns, by=("direction",), **filters),
            "windows": tone.tone_summary(self.windows, **filters),
            "timeline": tone.tone_timeline(self.turns, bucket, **filters),
            "coverage": tone.tone_coverage(self.turns, self.windows),
        })

    def conversation_stats(self, conversation_id: str | None = None, since=None, until=None) -> Answer:
        options = {"conversation_id": conversation_id, "since": since, "until": until}
        totals = stats.conversation_totals(self.messages, **options)
        share = stats.direction_share(filter_messages(self.messages, **options))
        return Answer({
            "totals": stats.public_times(totals, "first_message_at", "last_message_at"),
            "by_year": stats.conversation_by_year(self.messages, **options),
            "direction": share,
        })

    def sample_conversation(
        self, conversation_id: str, limit: int | None = None, since=None, until=None
    ) -> Answer:
        limit = clamp_limit(limit, 5, 2_500, 60)
        rows = reading.sample_conversation(self.messages, conversation_id, limit, since, until)
        return Answer({"messages": search.public_messages(rows, self.names)})

    def calendar_info(self) -> Answer:
        rows = agenda.calendar_info(self.events, self.key)
        return Answer({"calendars": stats.public_times(rows, "first_start", "last_end")})

    def search_calendar_events(self, query: str | None = None, **options) -> Answer:
        limit = strict_limit(options.pop("limit", None), 1_000, 100)
        options = {"chars": agenda.PREVIEW_CHARS, "limit": limit, **options}
        rows = agenda.search_calendar_events(self.events, self.key, query, **options)
        return Answer({"events": stats.public_times(rows, "start_at", "end_at")})

    def read_calendar_events(self, event_ids: list[str]) -> Answer:
        rows = agenda.read_calendar_events(self.events, self.key, event_ids, agenda.NOTES_CHARS)
        return Answer({"events": stats.public_times(rows, "start_at", "end_at")})
