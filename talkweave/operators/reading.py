"""Pages, samples and excerpts of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_all
from ..sources.archive import conversation_ids as chat_dimension
from .filters import in_period
from .ranking import rank_by_time


def newest(
    df: DataFrame, limit: int | None, time: str = "sent_at", identifier: str = "message_id"
) -> DataFrame:
    """The newest rows, ties by id; all of them without a limit."""
    ordered = df.orderBy(F.col(time).desc_nulls_last(), F.col(identifier).desc())
    return ordered if limit is None else ordered.limit(limit)


def read_conversation(
    messages: DataFrame,
    conversation_id: str,
    limit: int | None = None,
    before: tuple | None = None,
    since=None,
    until=None,
) -> DataFrame:
    """The newest page of one conversation, oldest first.

    `before` is the (sent_at, message_id) of the oldest row already read.
    """
    rows = messages.filter(F.col("conversation_id") == conversation_id)
    rows = in_period(rows, "sent_at", since, until)
    if before is not None:
        at, identifier = before
        edge = F.lit(at)
        rows = rows.filter(
            (F.col("sent_at") < edge)
            | ((F.col("sent_at") == edge) & (F.col("message_id") < identifier))
        )
    return newest(rows, limit).orderBy("sent_at", "message_id")


def next_cursor(page: DataFrame, limit: int | None = None) -> DataFrame:
    """Where the next page ends: the oldest row of a full page, nulls for a short one."""
    full = F.lit(False) if limit is None else F.count("*") == limit
    oldest = F.min(F.struct("sent_at", "message_id"))
    return page.agg(F.when(full, oldest).alias("oldest")).select("oldest.*")


def _sampled(
    messages: DataFrame, limit: int, spread: bool, bits: int | None = None
) -> DataFrame:
    keys = ["conversation_id"]
    narrow = messages.select(*keys, "sent_at", "message_id")
    options = {} if bits is None else {"bits": bits}
    ranked = rank_by_time(narrow, keys, "sent_at", "message_id", **options)
    zero = F.col("rank") - 1
    if spread:
        # rank r is hit by some k in 0..limit-1 with floor(k * total / limit) = r
        k = F.ceil(zero * limit / F.col("total"))
        chosen = (k < limit) & (F.floor(k * F.col("total") / limit) == zero)
        chosen = chosen | (F.col("total") <= limit)
    else:
        step = F.greatest(F.lit(1), F.floor(F.col("total") / limit))
        chosen = (zero % step == 0) & (zero < step * limit)
    return ranked.filter(chosen).select(*keys, "message_id", "rank")


def sample_conversations(
    messages: DataFrame, limit: int = 60, since=None, until=None, spread: bool = False,
    bits: int | None = None,
) -> DataFrame:
    """An evenly spaced sample of every conversation.

    Only the three key columns are ranked; the rows themselves join back by key.
    """
    rows = in_period(messages, "sent_at", since, until)
    picked = _sampled(rows, limit, spread, bits)
    return rows.join(picked, ["conversation_id", "message_id"])


def sample_conversation(
    messages: DataFrame, conversation_id: str, limit: int = 60, since=None, until=None,
    spread: bool = False,
) -> DataFrame:
    """The sample of one conversation, in order."""
    rows = messages.filter(F.col("conversation_id") == conversation_id)
    rows = in_period(rows, "sent_at", since, until)
    picked = _sampled(rows, limit, spread)
    return rows.join(picked, ["conversation_id", "message_id"]).orderBy("rank")


def recent_conversations(conversations: DataFrame, k: int = 7) -> DataFrame:
    """The k most recent named one-to-one conversations; further columns stay."""
    personal = (
        (F.col("name") != "Unnamed conversation")
        & (F.size("participants") == 1)
        & (F.col("participants")[0] != "Unknown person")
    )
    newest_first = [F.col("last_message_at").desc_nulls_last(), F.col("conversation_id")]
    return conversations.filter(personal).orderBy(*newest_first).limit(k)


def recent_excerpts(
    messages: DataFrame, conversations: DataFrame, k: int = 7, n: int = 100
) -> DataFrame:
    """The newest messages of the k most recent named one-to-one conversations.

    conversations: conversation_id, name, participants (array of names),
    last_message_at.
    """
    return excerpts_of(messages, recent_conversations(conversations, k), n)


def excerpts_of(messages: DataFrame, chosen: DataFrame, n: int = 100) -> DataFrame:
    """The newest n messages of each chosen conversation, without blank ones.

    The ranking keeps n rows per conversation in each task before it shuffles.
    """
    recent = Window.partitionBy("conversation_id").orderBy(
        F.col("sent_at").desc_nulls_last(), F.col("message_id").desc()
    )
    text = trim_all(F.col("text"))
    return (
        messages.join(
            chosen.select("conversation_id", "name", "last_message_at"), "conversation_id"
        )
        .withColumn("place", F.row_number().over(recent))
        .filter(F.col("place") <= n)
        .withColumn("text", text)
        .filter(F.col("text") != "")
        .select(
            "conversation_id", "name", "last_message_at", "message_id", "sent_at", "direction", "text"
        )
    )


def resolve_ids(dimension: DataFrame, column: str, wanted: list[str], label: str) -> DataFrame:
    """Rows of a dimension for the given opaque ids; reading an unknown id fails."""
    spark = dimension.sparkSession
    asked = spark.createDataFrame([(w,) for w in dict.fromkeys(wanted)], f"{column} string")
    unknown = F.raise_error(F.concat(F.lit(f"no such {label}: "), F.col(column)))
    known = dimension.withColumn("__known", F.lit(True))
    rows = asked.join(known, column, "left").filter(
        F.coalesce(F.col("__known"), unknown.cast("boolean"))
    )
    return rows.select(*dimension.columns)


def resolve_chats(
    archive: dict[str, DataFrame], key: bytes, conversation_ids: list[str]
) -> DataFrame:
    """`chat_id` of opaque conversation ids; reading an unknown one fails."""
    dimension = chat_dimension(archive["chat"], key)
    return resolve_ids(dimension, "conversation_id", conversation_ids, "conversation_id").select("chat_id")
