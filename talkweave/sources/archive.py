"""The raw archive: messages, conversations, handles and their bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import normalize_epoch
from ..functions.identity import opaque_id
from ..functions.redaction import redact_each
from ..functions.text import content, private_attachment_name
from ..operators.filters import real_messages

TABLES = ("message", "chat", "handle", "chat_message", "chat_handle", "attachment")
SALTS = 1_024


def load_archive(
    spark: SparkSession, source: dict[str, str] | str, fmt: str = "parquet", **options: str
) -> dict[str, DataFrame]:
    """Read the archive tables, read-only.

    `source` maps table names to paths, or is a folder with one entry per
    table. With fmt="jdbc" it maps table names to database tables and the
    connection goes into options.
    """
    if isinstance(source, str):
        source = {name: f"{source.rstrip('/')}/{name}.parquet" for name in TABLES}
    missing = {"message", "chat", "handle", "chat_message", "chat_handle"} - source.keys()
    if missing:
        raise ValueError(f"archive tables missing: {', '.join(sorted(missing))}")
    reader = spark.read.format(fmt).options(**options)
    if fmt == "jdbc":
        return {name: reader.option("dbtable", table).load() for name, table in source.items()}
    return {name: reader.load(path) for name, path in source.items()}


def message_text(df: DataFrame) -> Column:
    """Plain text, else what was decoded from the rich-text blob."""
    if "decoded_text" in df.columns:
        return F.coalesce(F.col("text"), F.col("decoded_text"))
    return F.col("text")


def direction_of(is_from_me: Column) -> Column:
    return F.when(F.coalesce(is_from_me.cast("int"), F.lit(0)) != 0, F.lit("from_me")).otherwise(
        F.lit("to_me")
    )


def attachments_view(attachments: DataFrame) -> DataFrame:
    """`message_id, attachments`: safe names and types, the path itself is never shown."""
    name = private_attachment_name(F.coalesce("transfer_name", "filename"))
    return attachments.groupBy("message_id").agg(
        F.sort_array(
            F.collect_list(F.struct(name.alias("name"), F.col("mime_type").alias("mime_type")))
        ).alias("attachments")
    )


def handle_people(handles: DataFrame, key: bytes) -> DataFrame:
    """`handle_id, identifier, person_id`; an empty identifier is an unknown person."""
    identifier = F.col("id")
    return handles.select(
        F.col("rowid").alias("handle_id"),
        identifier.alias("identifier"),
        F.when(F.coalesce(identifier, F.lit("")) == "", F.lit("unknown"))
        .otherwise(opaque_id("person", identifier, key))
        .alias("person_id"),
    )


def conversation_ids(chats: DataFrame, key: bytes) -> DataFrame:
    return chats.select(
        F.col("rowid").alias("chat_id"),
        opaque_id("conv", F.col("rowid"), key).alias("conversation_id"),
    )


def normalize_messages(
    archive: dict[str, DataFrame],
    key: bytes,
    names: DataFrame | None = None,
    redacted: bool = True,
    with_attachments: bool = False,
    chats: DataFrame | None = None,
) -> DataFrame:
    """The canonical `messages` frame.

    Ids are keyed once per conversation and per handle, not once per message.
    `names` (`person_id, name`) adds the sender's name. `chats` (`chat_id`) keeps
    only some conversations.
    """
    raw = real_messages(archive["message"])
    if chats is not None:
        archive = dict(archive)
        for name in ("chat_message", "chat_handle"):
            archive[name] = archive[name].join(chats, "chat_id", "left_semi")
        archive["chat"] = archive["chat"].join(
            chats.select(F.col("chat_id").alias("rowid")), "rowid", "left_semi"
        )
        chosen = archive["chat_message"].select(F.col("message_id").alias("rowid"))
        raw = raw.join(chosen, "rowid", "left_semi")
    texts = [F.col("subject"), message_text(raw)]
    raw = raw.withColumn("__shown", redact_each(*texts) if redacted else F.array(*texts))
    messages = raw.select(
        F.col("rowid").alias("message_id"),
        normalize_epoch(F.col("date")).alias("sent_at"),
        direction_of(F.col("is_from_me")).alias("direction"),
        "handle_id",
        "service",
        F.col("__shown")[0].alias("subject"),
        F.col("__shown")[1].alias("text"),
        F.col("reply_to_guid").isNotNull().alias("is_reply"),
    )
    people = handle_people(archive["handle"], key).select("handle_id", "person_id")
    if names is not None:
        people = people.join(names.select("person_id", "name"), "person_id", "left")
    else:
        people = people.withColumn("name", F.lit(None).cast("string"))

    # Messages without a sender would all meet in one task; they get keys that match nothing.
    sender_key = F.coalesce(
        F.when(F.col("direction") == "to_me", F.col("handle_id")),
        -1 - F.pmod(F.hash("message_id"), F.lit(SALTS)),
    ).cast("long")
    senders = people.select(
        F.col("handle_id").cast("long").alias("__sender"), F.col("person_id"), F.col("name")
    )
    from_me = F.col("direction") == "from_me"
    messages = messages.withColumn("__sender", sender_key).join(senders, "__sender", "left")
    messages = messages.withColumns(
        {
            "speaker": F.when(from_me, F.lit("me")).otherwise(
                F.coalesce("person_id", F.lit("unknown"))
            ),
            "sender_name": F.when(from_me, F.lit("You")).otherwise(
                F.coalesce("name", F.lit("Unknown person"))
            ),
        }
    ).drop("__sender", "person_id", "name")

    members = participants(archive, key).select(
        "chat_id", F.array_sort(F.col("people.person_id")).alias("person_ids")
    )
    conversations = conversation_ids(archive["chat"], key).join(members, "chat_id", "left")
    placed = (
        archive["chat_message"]
        .select("chat_id", "message_id")
        .dropDuplicates()
        .join(conversations, "chat_id")
    )
    result = placed.join(messages, "message_id").withColumn(
        "person_ids", F.coalesce("person_ids", F.array().cast("array<string>"))
    )
    columns = [
        "conversation_id", "message_id", "sent_at", "direction", "speaker", "sender_name",
        "service", "subject", "text", "is_reply", "person_ids",
    ]
    if with_attachments:
        result = result.join(attachments_view(archive["attachment"]), "message_id", "left")
        empty = F.array().cast("array<struct<name:string,mime_type:string>>")
        result = result.withColumn("attachments", F.coalesce("attachments", empty))
        columns.append("attachments")
    return result.select(*columns)


def message_facts(archive: dict[str, DataFrame], key: bytes) -> DataFrame:
    """conversation_id, message_id, sent_at, direction: what counts and periods need, no text."""
    messages = real_messages(archive["message"]).select(
        F.col("rowid").alias("message_id"),
        normalize_epoch(F.col("date")).alias("sent_at"),
        direction_of(F.col("is_from_me")).alias("direction"),
    )
    placed = archive["chat_message"].select("chat_id", "message_id").dropDuplicates()
    conversations = conversation_ids(archive["chat"], key)
    return (
        placed.join(messages, "message_id")
        .join(conversations, "chat_id")
        .select("conversation_id", "message_id", "sent_at", "direction")
    )


def participants(archive: dict[str, DataFrame], key: bytes) -> DataFrame:
    """`chat_id, people`: members in handle order, as array<struct<handle_id, identifier, person_id>>."""
    members = archive["chat_handle"].select("chat_id", "handle_id").dropDuplicates()
    people = handle_people(archive["handle"], key).filter(F.col("identifier").isNotNull())
    return (
        members.join(people, "handle_id")
        .groupBy("chat_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("handle_id", "identifier", "person_id"))).alias(
                "people"
            )
        )
    )


def index_content(messages: DataFrame) -> DataFrame:
    """Adds `content` (subject and text); rows without any are not indexed."""
    return messages.withColumn("content", content(F.col("subject"), F.col("text"))).filter(
        F.col("content") != ""
    )
