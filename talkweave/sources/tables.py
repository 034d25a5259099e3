"""Maintenance of derived tables: append, upsert, replace, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_new(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of batch whose key is not stored yet, each key once.

    Returns only what has to be appended, so a repeated batch appends nothing.
    """
    return batch.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upsert(
    existing: DataFrame, batch: DataFrame, keys: list[str], order: Column | str
) -> DataFrame:
    """The table after INSERT ... ON CONFLICT DO UPDATE; within batch the highest order wins."""
    order = F.col(order) if isinstance(order, str) else order
    latest = Window.partitionBy(*keys).orderBy(order.desc())
    newest = batch.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n")
    kept = existing.join(newest.select(*keys), keys, "left_anti")
    return kept.unionByName(newest, allowMissingColumns=True)


def replace_conversations(
    existing: DataFrame, rebuilt: DataFrame, changed: DataFrame | None = None
) -> DataFrame:
    """The table with every derived row of the changed conversations replaced.

    `changed` (`conversation_id`) also covers conversations that have no rows any more.
    """
    gone = (changed if changed is not None else rebuilt).select("conversation_id").distinct()
    kept = existing.join(gone, "conversation_id", "left_anti")
    return kept.unionByName(rebuilt, allowMissingColumns=True)


def write_index(
    df: DataFrame,
    path: str,
    sort: tuple[str, ...] = ("conversation_id", "start_at"),
    files: int | None = None,
    mode: str = "overwrite",
) -> None:
    """Parquet laid out for range access by the sort columns.

    Range partitioning splits a large conversation over several files, and the
    sort makes row-group statistics prune by conversation and date.
    """
    laid_out = df.repartitionByRange(files, *sort) if files else df.repartitionByRange(*sort)
    laid_out.sortWithinPartitions(*sort).write.mode(mode).parquet(path)


def write_partitioned(df: DataFrame, path: str, by: str, sort: tuple[str, ...]) -> None:
    """Overwrite only the partitions present in df."""
    (
        df.repartitionByRange(by, *sort)
        .sortWithinPartitions(by, *sort)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )
