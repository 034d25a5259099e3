"""The benchmark tables seen as an archive: conversations, people, calendar, threads.

Column expressions only; every frame here grows with the table it is made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import use_utc

KEY = b"benchmark-identity-key"
GROUP_CHAT = 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def messages_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id AS STRING) AS conversation_id",
        "event_id AS message_id",
        "ts AS sent_at",
        "CASE WHEN event_type IN ('purchase', 'click') THEN 'from_me' ELSE 'to_me' END AS direction",
        "CASE WHEN event_type IN ('purchase', 'click') THEN 'me' ELSE event_type END AS speaker",
        "concat(event_type, ' ', props) AS text",
        "array(concat('u', user_id), concat('g', user_id % 25)) AS person_ids",
    )


def messages_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role in ('user', 'assistant')").selectExpr(
        "CAST(conv_id AS STRING) AS conversation_id",
        "conv_id * 1000 + turn AS message_id",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + "
        "make_dt_interval(CAST(conv_id AS INT), 0, 0, turn * 90) AS sent_at",
        "CASE WHEN role = 'user' THEN 'from_me' ELSE 'to_me' END AS direction",
        "CASE WHEN role = 'user' THEN 'me' ELSE 'contact' END AS speaker",
        "text",
    )


def calendar_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS STRING) AS source_id",
        "event_type AS calendar_id",
        "event_type AS calendar",
        "concat(event_type, '-', user_id) AS title",
        "ts AS start_at",
        "ts + make_dt_interval(0, 0, CAST(floor(value) AS INT), 0) AS end_at",
        "user_id % 5 = 0 AS is_all_day",
        "CASE WHEN user_id % 3 = 0 THEN concat('Room ', user_id) END AS location",
        "props AS notes",
        "CASE WHEN user_id % 4 = 0 THEN 'confirmed' END AS status",
        "CAST(NULL AS STRING) AS availability",
    )


def passages_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    embeddings = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding"
    )
    return documents.join(embeddings, "doc_id", "left").selectExpr(
        "doc_id AS passage_id",
        "source AS conversation_id",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id AS INT), 0, 0) AS start_at",
        "TIMESTAMP_NTZ'2024-01-01 02:00:00' + make_dt_interval(0, CAST(doc_id AS INT), 0, 0) AS end_at",
        "array(lang) AS person_ids",
        "array(CASE WHEN doc_id % 2 = 0 THEN 'from_me' ELSE 'to_me' END) AS directions",
        "text",
        "1 AS message_count",
        "embedding",
    )


def messages_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages, one conversation per source."""
    return table(spark, sf_dir, "documents").selectExpr(
        "source AS conversation_id",
        "doc_id AS message_id",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id AS INT), 0, 0) AS sent_at",
        "CASE WHEN doc_id % 2 = 0 THEN 'from_me' ELSE 'to_me' END AS direction",
        "text",
        "array(lang) AS person_ids",
    )


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector with vec_id 0: one row, as a model would hand it over."""
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").first().embedding


def threads_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role in ('user', 'assistant')").selectExpr(
        "CAST(conv_id AS STRING) AS thread_id",
        "conv_id * 1000 + turn AS id",
        "role",
        "text AS content",
        "CASE WHEN role = 'user' AND turn >= 4 THEN 'sending' ELSE 'delivered' END AS delivery_status",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + "
        "make_dt_interval(CAST(conv_id AS INT), 0, 0, turn * 90) AS created_at",
    )


def archive(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Raw archive tables: one chat per user, small group chats by nation, handles from customers."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    customers = table(spark, sf_dir, "customer")
    group_chat = f"{GROUP_CHAT} + floor(c_custkey / 100) * 25 + c_nationkey"
    members = customers.selectExpr("c_custkey", f"CAST({group_chat} AS BIGINT) AS chat_id")
    message = events.selectExpr(
        "event_id AS rowid",
        "CASE WHEN event_type <> 'view' THEN concat(event_type, ' ', props) END AS text",
        "concat('decoded ', props) AS decoded_text",
        "CASE WHEN event_id % 10 = 0 THEN concat('Re: ', event_type) END AS subject",
        "CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END AS is_from_me",
        "CASE WHEN user_id % 2 = 0 THEN 'chat' ELSE 'sms' END AS service",
        "CASE WHEN event_id % 7 = 0 THEN concat('m', event_id - 7) END AS reply_to_guid",
        "CASE WHEN event_type IN ('purchase', 'click') THEN 0 ELSE user_id + 1 END AS handle_id",
        "CASE WHEN event_id % 2 = 0 "
        "THEN (unix_micros(CAST(ts AS TIMESTAMP)) - 978307200000000) * 1000 "
        "ELSE (unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000000) - 978307200 END AS date",
        "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS item_type",
    )
    direct = events.select("user_id").distinct().selectExpr(
        "user_id + 1 AS rowid",
        "CASE WHEN user_id % 8 = 0 THEN concat('Team ', user_id) "
        "WHEN user_id % 8 = 4 THEN concat('call 1555', lpad(user_id, 7, '0')) END AS display_name",
        "concat('chat', user_id) AS chat_identifier",
        "'chat' AS service_name",
        "CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS is_archived",
    )
    group = members.groupBy("chat_id").agg(F.min("c_custkey").alias("k")).selectExpr(
        "chat_id AS rowid",
        "CAST(NULL AS STRING) AS display_name",
        "concat('group', k) AS chat_identifier",
        "'sms' AS service_name",
        "0 AS is_archived",
    )
    purchases = events.filter("event_type = 'purchase'").join(
        members, F.col("user_id") == F.col("c_custkey")
    )
    chat_message = events.selectExpr("user_id + 1 AS chat_id", "event_id AS message_id").unionAll(
        purchases.selectExpr("chat_id", "event_id AS message_id")
    )
    chat_handle = (
        events.select("user_id")
        .distinct()
        .selectExpr("user_id + 1 AS chat_id", "user_id + 1 AS handle_id")
        .unionAll(members.selectExpr("chat_id", "c_custkey + 1 AS handle_id"))
    )
    handle = customers.selectExpr(
        "c_custkey + 1 AS rowid",
        "CASE WHEN c_custkey % 2 = 0 THEN concat('+1 (555) ', lpad(c_custkey, 7, '0')) "
        "ELSE concat('customer', c_custkey, '@example.com') END AS id",
    )
    attachment = table(spark, sf_dir, "pages").selectExpr(
        "page_id DIV 2 AS message_id",
        "url AS filename",
        "CASE WHEN page_id % 3 = 0 THEN concat('Photo ', page_id, '.JPG') "
        "WHEN page_id % 3 = 1 THEN ' ' END AS transfer_name",
        "CASE WHEN page_id % 3 = 0 THEN 'image/jpeg' ELSE 'text/html' END AS mime_type",
    )
    return {
        "message": message,
        "chat": direct.unionAll(group),
        "handle": handle,
        "chat_message": chat_message,
        "chat_handle": chat_handle,
        "attachment": attachment,
    }


def address_books(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, DataFrame]]:
    """Two contact sources with different columns and overlapping identifiers."""
    customers = table(spark, sf_dir, "customer")
    personal = customers.filter("c_custkey % 3 <> 0")
    people = personal.selectExpr(
        "c_custkey AS id",
        "CASE WHEN c_custkey % 7 <> 0 THEN initcap(c_mktsegment) END AS first_name",
        "CASE WHEN c_custkey % 7 <> 0 THEN concat('C', c_custkey) END AS last_name",
        "CASE WHEN c_custkey % 5 <> 0 THEN concat('Nick', c_custkey) END AS nickname",
        "concat('Org ', c_nationkey) AS organization",
        "CASE WHEN c_custkey % 11 = 0 THEN concat('reach me at c', c_custkey, '@example.com') "
        "ELSE 'Buyer' END AS job_title",
    )
    values = personal.selectExpr(
        "c_custkey AS owner",
        "CASE WHEN c_custkey % 2 = 0 THEN concat('(555) ', lpad(c_custkey, 7, '0')) "
        "ELSE concat(' CUSTOMER', c_custkey, '@Example.com') END AS value",
    )
    firms = customers.filter("c_custkey % 2 = 0")
    firm_people = firms.selectExpr(
        "c_custkey AS id",
        "CAST(NULL AS STRING) AS first_name",
        "CAST(NULL AS STRING) AS last_name",
        "concat('Firm ', c_custkey) AS organization",
        "concat('Dept ', c_nationkey) AS department",
    )
    firm_values = firms.selectExpr(
        "c_custkey AS owner", "concat('1-555-', lpad(c_custkey, 7, '0')) AS value"
    )
    return [(people, values), (firm_people, firm_values)]
