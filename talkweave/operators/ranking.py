"""Exact positions inside groups of any size.

A plain `row_number` over a conversation puts the whole conversation into one
task. Here a group is cut into slots that are bounded by construction, the rows
of each slot are counted before anything moves, and a row's position is the
count of the slots before its own plus its position in the slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import micros

SLOT_BITS = 16  # at most 2**16 distinct ids in one slot
LOWEST = -(2**62)


def _before(count: str, keys: list, order: list) -> Column:
    """Sum of count over the earlier rows of a group."""
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(earlier), F.lit(0))


def slot_of(identifier: Column, bits: int = SLOT_BITS) -> Column:
    return F.shiftright(identifier.cast("long"), bits)


def rank_by_id(
    df: DataFrame, keys: list[str], identifier: str, out: str = "rank", bits: int = SLOT_BITS
) -> DataFrame:
    """1-based position by an integer id that is unique inside the keys."""
    rows = df.withColumn("__slot", slot_of(F.col(identifier), bits))
    group = [*keys, "__slot"]
    sizes = rows.groupBy(*group).agg(F.count("*").alias("__size"))
    offsets = sizes.select(*group, _before("__size", keys, ["__slot"]).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(identifier))
    return (
        rows.withColumn("__inside", inside)
        .join(offsets, group, "left")
        .withColumn(out, F.col("__before") + F.col("__inside"))
        .drop("__slot", "__inside", "__before")
    )


def rank_by_time(
    df: DataFrame,
    keys: list[str],
    time: str,
    identifier: str,
    out: str = "rank",
    total: str = "total",
    bits: int = SLOT_BITS,
) -> DataFrame:
    """1-based position by (time, id), and the size of the group; null times come first.

    Slots are (instant, id range), so even a third of all rows at one instant
    is split; minutes sit above them to keep the running sums short.
    """
    tick = F.coalesce(micros(F.col(time)), F.lit(LOWEST))
    minute = F.coalesce(
        F.unix_seconds(F.date_trunc("minute", F.col(time).cast("timestamp"))), F.lit(LOWEST)
    )
    rows = (
        df.withColumn("__minute", minute)
        .withColumn("__tick", tick)
        .withColumn("__slot", slot_of(F.col(identifier), bits))
    )
    coarse, fine = [*keys, "__minute"], [*keys, "__minute", "__tick", "__slot"]

    minutes = rows.groupBy(*coarse).agg(F.count("*").alias("__size"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    minutes = minutes.select(
        *coarse,
        _before("__size", keys, ["__minute"]).alias("__minute_before"),
        F.sum("__size").over(whole).alias(total),
    )
    sizes = rows.groupBy(*fine).agg(F.count("*").alias("__size"))
    offsets = sizes.select(
        *fine, _before("__size", coarse, ["__tick", "__slot"]).alias("__slot_before")
    ).join(minutes, coarse)
    inside = F.row_number().over(Window.partitionBy(*fine).orderBy(identifier))
    return (
        rows.withColumn("__inside", inside)
        .join(offsets, fine, "left")
        .withColumn(out, F.col("__minute_before") + F.col("__slot_before") + F.col("__inside"))
        .drop("__minute", "__tick", "__slot", "__inside", "__minute_before", "__slot_before")
    )
