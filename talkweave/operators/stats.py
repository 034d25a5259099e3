"""Counts and activity. Every aggregate here combines inside the tasks before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import archive_seconds, iso_text, normalize_epoch, period
from ..functions.redaction import safe_label
from ..functions.identity import normalize_identifier, opaque_id
from ..session import cut_lineage
from ..sources.archive import handle_people
from ..sources.contacts import PROFILE, enrich_people, match_contacts
from .filters import any_contains, filter_messages, real_messages

UNKNOWN = "Unknown person"


def database_info(archive: dict[str, DataFrame]) -> DataFrame:
    """Messages, conversations with at least one message, people."""
    messages = real_messages(archive["message"]).select(F.col("rowid").alias("message_id"))
    used = archive["chat_message"].join(messages, "message_id", "left_semi").select("chat_id")
    chats = archive["chat"].select(F.col("rowid").alias("chat_id"))
    conversations = chats.join(used, "chat_id", "left_semi")
    counts = [
        messages.select(F.lit("messages").alias("what")),
        conversations.select(F.lit("conversations").alias("what")),
        archive["handle"].select(F.lit("people").alias("what")),
    ]
    every = counts[0].unionAll(counts[1]).unionAll(counts[2])
    return every.agg(
        *[
            F.count_if(F.col("what") == name).alias(name)
            for name in ("messages", "conversations", "people")
        ]
    )


def conversation_name(display_name: Column, known: Column) -> Column:
    """The safe display name, else the known participants, else a fixed label."""
    joined = F.when(F.size(known) > 0, F.array_join(known, ", "))
    return F.coalesce(safe_label(display_name), joined, F.lit("Unnamed conversation"))


def name_conversations(chats: DataFrame, members: DataFrame) -> DataFrame:
    """`chat_id, name`. members: chat_id, names (array of participant names in order)."""
    known = F.filter("names", lambda n: n != UNKNOWN)
    return chats.join(members, "chat_id", "left").select(
        "chat_id", conversation_name(F.col("display_name"), known).alias("name")
    )


def _last_dates(archive: dict[str, DataFrame]) -> DataFrame:
    """`chat_id, last_date`: one row per conversation before anything else is joined."""
    dates = real_messages(archive["message"]).select(
        F.col("rowid").alias("message_id"), archive_seconds(F.col("date")).alias("date")
    )
    bridge = archive["chat_message"].select("chat_id", "message_id")
    return bridge.join(dates, "message_id").groupBy("chat_id").agg(F.max("date").alias("last_date"))


def conversation_directory(
    archive: dict[str, DataFrame],
    contacts: DataFrame,
    key: bytes,
    page: DataFrame | None = None,
) -> DataFrame:
    """Conversations with safe name, participants, service and last message.

    `page` (`chat_id, last_date`) names only some conversations.
    """
    chats = archive["chat"].withColumnRenamed("rowid", "chat_id")
    links = archive["chat_handle"].select("chat_id", "handle_id").dropDuplicates()
    if page is None:
        chats = chats.join(_last_dates(archive), "chat_id", "left")
    else:
        chats = chats.join(page, "chat_id")
        links = links.join(page.select("chat_id"), "chat_id", "left_semi")
    handles = handle_people(archive["handle"], key).filter(F.col("person_id") != "unknown")
    linked = links.join(handles, "handle_id")
    people = enrich_people(linked, contacts).select("chat_id", "handle_id", "person_id", "name")
    members = (
        people.groupBy("chat_id")
        .agg(F.sort_array(F.collect_list(F.struct("handle_id", "person_id", "name"))).alias("who"))
        .select(
            "chat_id",
            F.col("who.name").alias("names"),
            F.col("who.person_id").alias("person_ids"),
        )
    )
    known = F.filter("names", lambda n: n != UNKNOWN)
    empty = F.array().cast("array<string>")
    return chats.join(members, "chat_id", "left").select(
        "chat_id",
        opaque_id("conv", F.col("chat_id"), key).alias("conversation_id"),
        conversation_name(F.col("display_name"), known).alias("name"),
        F.coalesce("names", empty).alias("participants"),
        F.coalesce("person_ids", empty).alias("person_ids"),
        F.col("service_name").alias("service"),
        (F.coalesce(F.col("is_archived").cast("int"), F.lit(0)) != 0).alias("archived"),
        normalize_epoch(F.col("last_date")).alias("last_message_at"),
    )


def _handles_like(archive: dict[str, DataFrame], contacts: DataFrame, needle: str) -> DataFrame:
    """`handle_id` of the people whose contact fields contain the needle."""
    keyed = archive["handle"].select(
        F.col("rowid").alias("handle_id"), normalize_identifier(F.col("id")).alias("identifier_key")
    )
    return keyed.join(match_contacts(contacts, needle), "identifier_key", "left_semi").select(
        "handle_id"
    )


def list_conversations(
    archive: dict[str, DataFrame],
    contacts: DataFrame,
    key: bytes,
    query: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The most recent conversations; query matches names, identifiers and contact fields.

    The page is chosen first, on ids and dates alone; only its conversations are
    named. Without a limit all are listed.
    """
    chats = archive["chat"].withColumnRenamed("rowid", "chat_id")
    needle = (query or "").strip()
    if needle:
        like_id = archive["handle"].filter(any_contains(["id"], needle))
        handles = _handles_like(archive, contacts, needle).unionAll(
            like_id.select(F.col("rowid").alias("handle_id"))
        )
        by_handle = archive["chat_handle"].join(handles, "handle_id", "left_semi").select("chat_id")
        by_name = chats.filter(any_contains(["display_name", "chat_identifier"], needle))
        chats = chats.join(
            by_handle.unionAll(by_name.select("chat_id")), "chat_id", "left_semi"
        )
    page = chats.select("chat_id").join(_last_dates(archive), "chat_id", "left")
    if limit is not None:
        # Written, as names and people are looked up by it separately.
        page = cut_lineage(
            page.orderBy(F.col("last_date").desc_nulls_last(), F.col("chat_id")).limit(limit)
        )
    return (
        conversation_directory(archive, contacts, key, page)
        .orderBy(F.col("last_message_at").desc_nulls_last(), "chat_id")
        .drop("chat_id")
    )


def list_people(
    archive: dict[str, DataFrame],
    contacts: DataFrame,
    key: bytes,
    query: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """People with their number of conversations and last activity, newest first.

    Only the people on the page get their contact fields; without a limit, all do.
    """
    activity = (
        archive["chat_handle"]
        .select("chat_id", "handle_id")
        .dropDuplicates()
        .join(_last_dates(archive), "chat_id", "left")
        .groupBy("handle_id")
        .agg(F.count("*").alias("conversation_count"), F.max("last_date").alias("last_date"))
    )
    people = handle_people(archive["handle"], key).filter(F.col("identifier").isNotNull())
    needle = (query or "").strip()
    if needle:
        people = people.join(_handles_like(archive, contacts, needle), "handle_id", "left_semi")
    newest_first = [F.col("last_date").desc_nulls_last(), F.col("handle_id")]
    page = people.join(activity, "handle_id", "left").orderBy(*newest_first)
    if limit is not None:
        page = page.limit(limit)
    return (
        enrich_people(page, contacts)
        .orderBy(*newest_first)
        .select(
            "person_id",
            *PROFILE,
            F.coalesce("conversation_count", F.lit(0)).alias("conversation_count"),
            normalize_epoch(F.col("last_date")).alias("last_message_at"),
        )
    )


def indexable_conversations(
    archive: dict[str, DataFrame], contacts: DataFrame, key: bytes
) -> DataFrame:
    """Conversations that have messages, with their distinct message count, name and people."""
    messages = real_messages(archive["message"]).select(F.col("rowid").alias("message_id"))
    counts = (
        archive["chat_message"]
        .join(messages, "message_id", "left_semi")
        .groupBy("chat_id")
        .agg(F.countDistinct("message_id").alias("message_count"))
        .filter("message_count > 0")
    )
    directory = conversation_directory(archive, contacts, key)
    return counts.join(directory.select("chat_id", "conversation_id", "name", "person_ids"), "chat_id")


def _direction_counts() -> list[Column]:
    return [
        F.count("*").alias("messages"),
        F.count_if("sent").alias("from_me"),
        F.count_if("received").alias("to_me"),
    ]


def _each_message_once(messages: DataFrame) -> DataFrame:
    """A message in two conversations counts once. Flags instead of text keep the hash aggregate."""
    return messages.groupBy("message_id").agg(
        F.max(F.col("direction") == "from_me").alias("sent"),
        F.max(F.col("direction") == "to_me").alias("received"),
        F.max("sent_at").alias("sent_at"),
    )


def conversation_totals(messages: DataFrame, **filters) -> DataFrame:
    """Messages, sent, received, first and last date, number of conversations."""
    chosen = filter_messages(messages, **filters)
    # One pass: a row per message, and a row per conversation and task, told apart by `what`.
    facts = F.array(
        F.struct(
            F.col("message_id").cast("string").alias("what"),
            F.col("direction").eqNullSafe("from_me").alias("sent"),
            F.col("direction").eqNullSafe("to_me").alias("received"),
            F.col("sent_at").alias("sent_at"),
        ),
        F.struct(
            F.concat(F.lit("c"), F.col("conversation_id")).alias("what"),
            F.lit(None).cast("boolean").alias("sent"),
            F.lit(None).cast("boolean").alias("received"),
            F.lit(None).cast(chosen.schema["sent_at"].dataType).alias("sent_at"),
        ),
    )
    once = chosen.select(F.inline(facts)).groupBy("what").agg(
        F.max("sent").alias("sent"),
        F.max("received").alias("received"),
        F.max("sent_at").alias("sent_at"),
    )
    is_message = F.col("sent").isNotNull()
    return once.agg(
        F.count_if(is_message).alias("messages"),
        F.count_if("sent").alias("from_me"),
        F.count_if("received").alias("to_me"),
        F.min("sent_at").alias("first_message_at"),
        F.max("sent_at").alias("last_message_at"),
        F.count_if(~is_message).alias("conversations"),
    )


def conversation_by_period(messages: DataFrame, bucket: str = "year", **filters) -> DataFrame:
    """Activity per year (or quarter, month, day), in order."""
    label = (
        F.date_format("sent_at", "yyyy-MM-dd")
        if bucket == "day"
        else period(F.col("sent_at"), bucket)
    )
    once = _each_message_once(filter_messages(messages, **filters))
    return once.groupBy(label.alias(bucket)).agg(*_direction_counts()).orderBy(bucket)


def conversation_by_year(messages: DataFrame, **filters) -> DataFrame:
    return conversation_by_period(messages, "year", **filters)


def direction_share(messages: DataFrame) -> DataFrame:
    """Sent and received with their percentages; 0 when there is nothing."""
    counts = messages.agg(
        F.count_if(F.col("direction") == "from_me").alias("sent_count"),
        F.count_if(F.col("direction") == "to_me").alias("received_count"),
    )
    total = F.col("sent_count") + F.col("received_count")

    def percent(name: str) -> Column:
        return F.when(total > 0, F.col(name) * 100.0 / total).otherwise(F.lit(0.0))

    return counts.select(
        "sent_count",
        "received_count",
        percent("sent_count").alias("sent_percent"),
        percent("received_count").alias("received_percent"),
    )


def messages_read(results: DataFrame) -> DataFrame:
    """Messages each tool returned: one per row, or the message count of each passage."""
    is_passage = F.col("tool").endswith("search_context")
    is_message = (
        F.col("tool").endswith("search_messages")
        | F.col("tool").endswith("read_conversation")
        | F.col("tool").endswith("sample_conversation")
    )
    value = (
        F.when(is_passage, F.coalesce("message_count", F.lit(0)))
        .when(is_message, F.lit(1))
        .otherwise(F.lit(0))
    )
    return results.groupBy("tool").agg(F.sum(value.cast("long")).alias("messages_read"))


def evidence_tiers(themes: DataFrame, strength: str = "evidence_strength") -> DataFrame:
    """Themes per tier: broad (5 and more), repeated (4), limited (3 and less)."""
    tier = (
        F.when(F.col(strength) >= 5, F.lit("broad"))
        .when(F.col(strength) == 4, F.lit("repeated"))
        .otherwise(F.lit("limited"))
    )
    return themes.groupBy(tier.alias("tier")).agg(F.count("*").alias("themes"))


def public_times(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as the ISO text shown to callers."""
    return df.withColumns({c: iso_text(F.col(c)) for c in columns})
