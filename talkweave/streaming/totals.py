"""Totals kept by batch: what `conversation_totals` counts, without reading old messages again.

Every message becomes facts (it exists, it was sent or received, its conversation
exists), and Spark's streaming `dropDuplicates` lets each fact through once in the life
of the stream. A batch adds up the facts that are new in it, a row for each kind and day,
and writes the conversations among them. These summaries are folded when they are read, so
a batch costs what its own messages cost and a reader a few rows for each batch and day.

The distinct keys are exact and live in the state store, one for each message and direction,
kept in RocksDB on disk. A conversation is a fact once for each of SALTS hashes of its
messages, so one that holds a third of all rows is not one task.

Defined cases: a message in two conversations counts once, on the day and at the time of the row that
arrives first; one with both directions counts as sent and as received; rows with a null message
id, or without a direction, count as one message and in no direction; a null conversation id
is a conversation; a null time counts in the totals and on the day null; rows that repeat change nothing.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SALTS = 64
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KINDS = {"message": "messages", "from_me": "from_me", "to_me": "to_me"}


@contextmanager
def _rocks(spark: SparkSession):
    """A stream copies its session's settings when it starts."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def message_facts(messages: DataFrame) -> DataFrame:
    """kind, key, salt, sent_at: three rows for each message."""
    no_salt = F.lit(0).alias("salt")
    identifier = F.col("message_id").cast("string").alias("key")
    facts = F.array(
        F.struct(F.lit("message").alias("kind"), identifier, no_salt),
        F.struct(F.col("direction").alias("kind"), identifier, no_salt),
        F.struct(
            F.lit("conversation").alias("kind"),
            F.col("conversation_id").cast("string").alias("key"),
            F.pmod(F.xxhash64("message_id"), F.lit(SALTS)).cast("int").alias("salt"),
        ),
    )
    rows = messages.select(F.explode(facts).alias("fact"), "sent_at")
    return rows.select("fact.*", "sent_at").where(F.col("kind").isin("conversation", *KINDS))


def summarise_batch(fresh: DataFrame, batch_id: int, sink: str) -> None:
    """Write what the new facts of a batch add; a batch that is repeated overwrites its files."""
    fresh = fresh.persist()
    try:
        days = (
            fresh.where("kind <> 'conversation'")
            .groupBy("kind", F.to_date("sent_at").alias("day"))
            .agg(F.count("*").alias("n"), F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"))
        )
        days.coalesce(1).write.mode("overwrite").parquet(f"{sink}/days/batch_id={batch_id}")
        names = fresh.where("kind = 'conversation'").select(F.col("key").alias("conversation_id")).distinct()
        names.write.mode("overwrite").parquet(f"{sink}/conversations/batch_id={batch_id}")
    finally:
        fresh.unpersist()


def stream_totals(stream: DataFrame, sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the summaries of a stream of messages in `sink`."""
    facts = message_facts(stream).dropDuplicates(["kind", "key", "salt"])
    writer = facts.writeStream.foreachBatch(lambda batch, i: summarise_batch(batch, i, sink))
    writer = writer.option("checkpointLocation", checkpoint)
    with _rocks(stream.sparkSession):
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def _days(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.option("basePath", f"{sink}/days").parquet(f"{sink}/days")


def _counts() -> list:
    return [
        F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(name)
        for kind, name in KINDS.items()
    ]


def read_totals(spark: SparkSession, sink: str) -> DataFrame:
    """The row of `conversation_totals` over all that has arrived."""
    names = spark.read.parquet(f"{sink}/conversations").select("conversation_id").distinct()
    count = names.agg(F.count("*").alias("conversations"))
    of_messages = F.col("kind") == "message"
    totals = _days(spark, sink).agg(
        *_counts(),
        F.min(F.when(of_messages, F.col("first_at"))).alias("first_message_at"),
        F.max(F.when(of_messages, F.col("last_at"))).alias("last_message_at"),
    )
    one = F.lit(1).alias("one")  # one row each
    return totals.withColumn("one", one).join(count.withColumn("one", one), "one").drop("one")


def read_by_day(spark: SparkSession, sink: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """day, messages, from_me, to_me of the days from `since` up to, not including, `until` (yyyy-MM-dd)."""
    days = _days(spark, sink)
    if since is not None:
        days = days.where(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        days = days.where(F.col("day") < F.lit(until).cast("date"))
    return days.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(*_counts())
