"""Streams that keep the message table and everything derived from it up to date.

Every micro-batch writes folders named after its batch id and overwrites them
when it is repeated, so a batch that is retried after a crash leaves the same
files. What a batch reads about the past is limited to lower batch ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = "conversation_id"
BUCKETS = 64


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(path)


def _start(stream: DataFrame, run, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# --- message index ----------------------------------------------------------


def index_batch(batch: DataFrame, batch_id: int, sink: str) -> None:
    """Append the messages that are not stored yet, also those that arrive late.

    Messages carry a bucket of their conversation; only the buckets that a batch
    touches are read, and of these only the keys.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int")
    fresh = batch.dropDuplicates([KEY, "message_id"]).withColumn("bucket", bucket)
    if batch_id > 0:
        stored = _read(spark, f"{sink}/messages")
        if stored is not None:
            _refuse_later(stored, batch_id)
            # At most BUCKETS small integers; they prune the files of all other buckets.
            touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
            stored = stored.filter((F.col("batch_id") < batch_id) & F.col("bucket").isin(touched))
            fresh = fresh.join(stored.select("bucket", KEY, "message_id"), ["bucket", KEY, "message_id"], "left_anti")
    elif (stored := _read(spark, f"{sink}/messages")) is not None:
        _refuse_later(stored, batch_id)
    messages = f"{sink}/messages/batch_id={batch_id}"
    fresh = fresh.select(*batch.columns, "bucket")
    # Range partitioning splits a large conversation and keeps the number of files low.
    laid_out = fresh.repartitionByRange("bucket", KEY, "message_id")
    laid_out.write.mode("overwrite").partitionBy("bucket").parquet(messages)
    written = spark.read.schema(fresh.schema).parquet(messages)
    moved = written.groupBy(KEY).agg(F.max("message_id").alias("last_message_id"))
    moved.write.mode("overwrite").parquet(f"{sink}/moved/batch_id={batch_id}")


def _refuse_later(stored: DataFrame, batch_id: int) -> None:
    """A fresh checkpoint starts at batch 0 and would overwrite an old sink."""
    if stored.filter(F.col("batch_id") > batch_id).limit(1).count():
        raise ValueError("this sink holds later batches: its checkpoint is not the one given")


def stream_index(
    stream: DataFrame, sink: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Keep `sink/messages` up to date: every message once, whenever it arrives."""
    return _start(stream, lambda b, i: index_batch(b, i, sink), checkpoint, available_now)


def read_messages(spark: SparkSession, sink: str, upto: int | None = None) -> DataFrame:
    stored = spark.read.option("basePath", f"{sink}/messages").parquet(f"{sink}/messages")
    return stored if upto is None else stored.filter(F.col("batch_id") <= upto)


# --- rebuild of changed conversations ---------------------------------------


def rebuild_batch(
    batch: DataFrame,
    batch_id: int,
    sink: str,
    build: Callable[[DataFrame], DataFrame],
    name: str,
) -> None:
    """Index the batch, then rebuild every conversation it moved, whole, as a new version."""
    index_batch(batch, batch_id, sink)
    spark = batch.sparkSession
    changed = spark.read.parquet(f"{sink}/moved/batch_id={batch_id}").select(KEY)
    bucket = F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int")
    # At most BUCKETS small integers; they prune the files of all other buckets.
    touched = [r[0] for r in changed.select(bucket).distinct().collect()]
    messages = (
        read_messages(spark, sink, upto=batch_id)
        .filter(F.col("bucket").isin(touched))
        .join(changed, KEY, "left_semi")
    )
    build(messages.drop("bucket", "batch_id")).write.mode("overwrite").parquet(
        f"{sink}/{name}/version={batch_id}"
    )
    changed.write.mode("overwrite").parquet(
        f"{sink}/{name}_versions/version={batch_id}"
    )


def stream_rebuild(
    stream: DataFrame,
    sink: str,
    checkpoint: str,
    build: Callable[[DataFrame], DataFrame],
    name: str = "passages",
    available_now: bool = True,
) -> StreamingQuery:
    """Keep a derived table (`build` of the messages) at the state of a full rebuild."""
    return _start(
        stream, lambda b, i: rebuild_batch(b, i, sink, build, name), checkpoint, available_now
    )


def read_current(spark: SparkSession, sink: str, name: str = "passages") -> DataFrame:
    """Of every conversation, only the rows of its newest version."""
    stored = spark.read.option("basePath", f"{sink}/{name}").parquet(f"{sink}/{name}")
    versions = spark.read.option("basePath", f"{sink}/{name}_versions").parquet(
        f"{sink}/{name}_versions"
    )
    newest = versions.groupBy(KEY).agg(F.max("version").alias("version"))
    return stored.join(newest, [KEY, "version"], "left_semi").drop("version")


# --- pending enrichment -----------------------------------------------------


def pending(rows: DataFrame, results: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows that have no result yet."""
    return rows if results is None else rows.join(results.select(*keys), keys, "left_anti")


def enrich_batch(
    batch: DataFrame, batch_id: int, sink: str, keys: list[str],
    fn: Callable[[DataFrame], DataFrame],
) -> None:
    done = _read(batch.sparkSession, sink)
    if done is not None:
        done = done.filter(F.col("batch_id") < batch_id)
    todo = pending(batch.dropDuplicates(keys), done, keys)
    fn(todo).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")


def stream_enrich(
    stream: DataFrame,
    sink: str,
    checkpoint: str,
    keys: list[str],
    fn: Callable[[DataFrame], DataFrame],
    available_now: bool = True,
) -> StreamingQuery:
    """Run a model (`fn`: frame to frame) once for every key that arrives."""
    return _start(stream, lambda b, i: enrich_batch(b, i, sink, keys, fn), checkpoint, available_now)


def enrich_newest(
    rows: DataFrame, results: DataFrame | None, keys: list[str], newest: str, n: int,
    fn: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """One resumable step outside a stream: enrich the n newest rows without a result."""
    todo = pending(rows, results, keys).orderBy(F.col(newest).desc_nulls_last(), *keys).limit(n)
    return fn(todo)


def latest_result(results: DataFrame, keys: list[str]) -> DataFrame:
    """One result per key, of the newest batch, should a key have been enriched twice."""
    newest = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return results.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")
