"""Assistant threads, snapshots and suggestion lists."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import iso_argument, time_literal
from ..functions.text import trim_all

SNAPSHOT_VERSION, MANY_NEW, MAX_AGE_SECONDS = 4, 250, 86_400


def thread_summaries(messages: DataFrame) -> DataFrame:
    """Newest message as preview, number of messages, last update; newest thread first."""
    threads = messages.groupBy("thread_id").agg(
        F.max("id").alias("id"),
        F.count("*").alias("message_count"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
    )
    # Only the one text that is shown meets its thread.
    previews = messages.select("thread_id", "id", F.col("content").alias("preview"))
    return (
        threads.join(previews, ["thread_id", "id"])
        .select("thread_id", "preview", "message_count", "created_at", "updated_at")
        .orderBy(F.col("updated_at").desc(), "thread_id")
    )


def _settle(messages: DataFrame, status: str, answered: str) -> DataFrame:
    """Set the status of user messages in one state by whether a later reply exists.

    Only those messages meet the replies (one row per thread, aggregated
    first); all others pass through without a shuffle.
    """
    pending = F.coalesce(
        (F.col("role") == "user") & (F.col("delivery_status") == status), F.lit(False)
    )
    last_reply = (
        messages.filter(F.col("role") == "assistant")
        .groupBy("thread_id")
        .agg(F.max("id").alias("last_reply"))
    )
    settled = (
        messages.filter(pending)
        .join(last_reply, "thread_id", "left")
        .withColumn(
            "delivery_status",
            F.when(F.col("last_reply") > F.col("id"), F.lit(answered)).otherwise(F.lit("failed")),
        )
        .drop("last_reply")
    )
    return messages.filter(~pending).unionByName(settled)


def reconcile_delivery(messages: DataFrame) -> DataFrame:
    """Messages left in `sending`: delivered when a later reply exists, else failed."""
    return _settle(messages, "sending", "delivered")


def flag_orphans(messages: DataFrame) -> DataFrame:
    """Delivered user messages without a later reply become failed."""
    return _settle(messages, "delivered", "delivered")


def snapshot_is_stale(snapshots: DataFrame, message_count, now: datetime | str) -> DataFrame:
    """Adds `stale`: wrong version, empty, many new messages, or any new ones after a day."""
    now = iso_argument(now, "now")
    count = F.lit(message_count) if isinstance(message_count, int) else message_count
    new = count - F.col("source_message_count")
    age = F.unix_seconds(time_literal(now).cast("timestamp")) - F.unix_seconds(
        F.col("updated_at").cast("timestamp")
    )
    old = F.coalesce(age > MAX_AGE_SECONDS, F.lit(True))
    stale = (F.col("status") != "refreshing") & (
        (F.col("format_version") != SNAPSHOT_VERSION)
        | F.col("content").isNull()
        | (new >= MANY_NEW)
        | ((new > 0) & old)
    )
    return snapshots.withColumn("stale", stale)


def ordered_dedupe(
    df: DataFrame,
    group: str,
    value: str,
    order: str,
    min_len: int = 12,
    max_len: int = 68,
    k: int = 6,
    defaults: tuple[str, ...] = (),
) -> DataFrame:
    """The first k distinct values per group, by first appearance and of suitable length.

    Groups that have fewer than k fall back to the defaults, when given.
    """
    line = trim_all(F.regexp_replace(F.col(value), r"(?U)\s+", " "))
    firsts = (
        df.select(F.col(group), line.alias(value), F.col(order).alias("__o"))
        .filter(F.length(value).between(min_len, max_len))
        .groupBy(group, value)
        .agg(F.min("__o").alias("__o"))
    )
    place = F.row_number().over(Window.partitionBy(group).orderBy("__o", value))
    best = firsts.withColumn("place", place).filter(F.col("place") <= k).drop("__o")
    if not defaults:
        return best
    enough = best.filter(F.col("place") == k).select(group)
    fallback = F.posexplode(F.array(*[F.lit(d) for d in defaults[:k]]))
    others = (
        df.select(group)
        .distinct()
        .join(enough, group, "left_anti")
        .select(group, fallback.alias("at", value))
        .select(group, value, (F.col("at") + 1).alias("place"))
    )
    return best.join(enough, group, "left_semi").unionByName(others)
