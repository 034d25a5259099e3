"""Tables in buckets of a key, of which only the buckets that change are written again.

A bucket is a folder, named after a hash of the key and the number of buckets, so a table
knows its own layout. A change reads the buckets that it touches, writes their new rows
aside and switches them by dynamic partition overwrite: Spark writes a staging folder and
moves it in place when all tasks have succeeded. Other buckets keep their files. A change that
fails before the switch leaves the old table. One that is lost in the middle of it leaves
each bucket whole, old or new; the same change given again completes it.

One writer at a time; a reader that runs through a switch should be started again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import replace_conversations, upsert, write_partitioned

BUCKETS = 64
PREFIX = "bucket_of_"


def _number(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def _layout(spark: SparkSession, path: str) -> str:
    """The name of the bucket column, which holds the number of buckets."""
    names = [c for c in spark.read.parquet(path).columns if c.startswith(PREFIX)]
    if len(names) != 1:
        raise ValueError(f"{path} is not a table in buckets")
    return names[0]


def write_buckets(df: DataFrame, path: str, keys: list[str], sort: tuple[str, ...], buckets: int = BUCKETS) -> None:
    """A new table. Rows of a large key are spread over files by `sort`; an existing folder is refused."""
    if buckets < 1:
        raise ValueError("a table needs a bucket")
    column = f"{PREFIX}{buckets}"
    if any(c.startswith(PREFIX) for c in df.columns):
        raise ValueError(f"columns must not start with {PREFIX}")
    laid_out = df.withColumn(column, _number(keys, buckets)).repartitionByRange(column, *sort)
    laid_out.sortWithinPartitions(column, *sort).write.mode("errorifexists").partitionBy(column).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(_layout(spark, path))


def _switch(spark: SparkSession, path: str, keys: list[str], sort: tuple[str, ...], changes: list[DataFrame], build) -> list[int]:
    column = _layout(spark, path)
    number = _number(keys, int(column.removeprefix(PREFIX))).alias(column)
    named = reduce(DataFrame.unionAll, [c.select(number) for c in changes]).distinct()
    # At most as many small integers as there are buckets.
    touched = sorted(r[0] for r in named.collect())
    if not touched:
        return []
    old = spark.read.parquet(path).where(F.col(column).isin(touched)).drop(column)
    aside = cut_lineage(build(old).select(*old.columns).withColumn(column, number))
    full = {r[0] for r in aside.select(column).distinct().collect()}
    write_partitioned(aside, path, column, sort)
    _drop(spark, [f"{path}/{column}={n}" for n in touched if n not in full])
    return touched


def _drop(spark: SparkSession, folders: list[str]) -> None:
    """Buckets that have no rows any more; an overwrite does not name them."""
    for name in folders:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def replace_in_place(
    spark: SparkSession,
    path: str,
    rebuilt: DataFrame,
    changed: DataFrame | None = None,
    sort: tuple[str, ...] = ("conversation_id",),
) -> list[int]:
    """`replace_conversations` on a stored table with the key `conversation_id`; the buckets written.

    `changed` names conversations to replace, also those without rows any more. Rebuilt rows of
    a conversation that it does not name are added.
    """
    names = (rebuilt if changed is None else changed).select("conversation_id").distinct()
    changes = [names, rebuilt.select("conversation_id")]
    return _switch(
        spark, path, ["conversation_id"], sort, changes, lambda old: replace_conversations(old, rebuilt, names)
    )


def upsert_in_place(
    spark: SparkSession, path: str, batch: DataFrame, keys: list[str], order: str, sort: tuple[str, ...] | None = None
) -> list[int]:
    """`upsert` on a stored table whose buckets are those of `keys`; the buckets written."""
    return _switch(spark, path, keys, sort or tuple(keys), [batch], lambda old: upsert(old, batch, keys, order))
