"""Tone of turns and exchange windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import period, time_literal
from ..functions.scores import SCORES, round4, tone_from_logits
from .filters import DIRECTIONS, filter_messages, people_match

BATCH = 8


def score_tone(
    df: DataFrame, fn: Callable[[list[str]], np.ndarray], text: str = "text",
    model_version: str | None = None, batch: int = BATCH,
) -> DataFrame:
    """Scores from a user's classifier that returns (negative, neutral, positive) logits.

    The model runs in the tasks on Arrow batches, a few texts of similar length
    at a time; softmax, valence and confidence are Spark expressions.
    """

    @F.pandas_udf("array<double>")
    def logits(texts: pd.Series) -> pd.Series:
        order = np.argsort(texts.str.len().fillna(0).to_numpy(), kind="stable")
        out = [None] * len(texts)
        for at in range(0, len(order), batch):
            places = order[at : at + batch]
            values = np.asarray(fn([texts.iat[i] or "" for i in places]), dtype="float64")
            for place, row in zip(places, values):
                out[place] = row
        return pd.Series(out)

    scored = df.withColumn("__l", logits(F.col(text))).withColumn(
        "__s", tone_from_logits(F.col("__l")[0], F.col("__l")[1], F.col("__l")[2])
    )
    result = scored.withColumns({name: F.col(f"__s.{name}") for name in SCORES})
    if model_version is not None:
        result = result.withColumn("model_version", F.lit(model_version))
    return result.drop("__l", "__s")


def _aggregates() -> list[Column]:
    negative, neutral, positive = F.col("negative"), F.col("neutral"), F.col("positive")
    return [
        F.count("*").alias("count"),
        *[F.avg(name).alias(name) for name in SCORES],
        F.count_if((negative >= neutral) & (negative >= positive)).alias("negative_count"),
        F.count_if((neutral > negative) & (neutral >= positive)).alias("neutral_count"),
        F.count_if((positive > negative) & (positive > neutral)).alias("positive_count"),
    ]


def _published(df: DataFrame, by: Sequence[str]) -> DataFrame:
    def share(name: str) -> Column:
        part = F.when(F.col("count") > 0, F.col(f"{name}_count") / F.col("count"))
        return round4(F.coalesce(part, F.lit(0.0))).alias(f"{name}_share")

    return df.select(
        *by,
        "count",
        *[round4(F.coalesce(F.col(name), F.lit(0.0))).alias(name) for name in SCORES],
        *[share(name) for name in ("negative", "neutral", "positive")],
    )


def tone_summary(
    turns: DataFrame, by: Sequence[str] = (), people: DataFrame | None = None, person_ids=(),
    person_match: str = "any", direction: str | None = None, **filters,
) -> DataFrame:
    """Count, mean scores and share of each dominant class; rows without scores are left out.

    People are those of the conversation: `people` (`conversation_id, person_ids`)
    is needed to ask for some. Windows have a list of directions; one match is enough.
    """
    if direction in DIRECTIONS and "directions" in turns.columns:
        turns, direction = turns.filter(F.array_contains("directions", direction)), None
    rows = filter_messages(turns, time="start_at", direction=direction, **filters)
    rows = rows.filter("positive is not null")
    if person_ids:
        if people is None:
            raise ValueError("people of conversations are needed to choose by person")
        wanted = people.filter(people_match(F.col("person_ids"), person_ids, person_match))
        rows = rows.join(wanted.select("conversation_id"), "conversation_id", "left_semi")
    return _published(rows.groupBy(*by).agg(*_aggregates()), by)


def tone_timeline(turns: DataFrame, bucket: str = "month", **filters) -> DataFrame:
    dated = turns.withColumn("period", period(F.col("start_at"), bucket))
    return tone_summary(dated, ("period",), **filters).orderBy("period")


def tone_trends(turns: DataFrame, as_of: date | datetime) -> DataFrame:
    """Yearly points and the last twelve months; the current period is marked partial."""
    months = as_of.year * 12 + as_of.month - 1 - 11
    recent_start = datetime(months // 12, months % 12 + 1, 1)
    current = {"year": f"{as_of.year:04d}", "month": f"{as_of.year:04d}-{as_of.month:02d}"}

    scored = turns.filter("positive is not null")
    yearly = F.struct(F.lit("yearly").alias("series"), period(F.col("start_at"), "year").alias("period"))
    recent = F.struct(F.lit("recent").alias("series"), period(F.col("start_at"), "month").alias("period"))
    in_recent = F.col("start_at") >= time_literal(recent_start)
    # One pass: each turn is a point of its year and, when recent, of its month.
    points = F.explode(F.when(in_recent, F.array(yearly, recent)).otherwise(F.array(yearly)))
    placed = scored.select(*SCORES, points.alias("p")).select(*SCORES, "p.series", "p.period")
    totals = _published(
        placed.groupBy("series", "period").agg(*_aggregates()), ("series", "period")
    )
    return totals.select(
        "series",
        "period",
        "count",
        F.col("positive_share").alias("positive"),
        F.col("neutral_share").alias("neutral"),
        F.col("negative_share").alias("negative"),
        F.col("valence").alias("net"),
        F.col("period").isin(*current.values()).alias("partial"),
    ).orderBy("series", "period")


def tone_coverage(turns: DataFrame, windows: DataFrame) -> DataFrame:
    """Share of turns and windows that have been scored."""
    every = turns.select("positive").unionAll(windows.select("positive"))
    return every.agg(
        F.count("*").alias("total"),
        F.count("positive").alias("analyzed"),
        round4(
            F.when(F.count("*") > 0, F.count("positive") * 100.0 / F.count("*")).otherwise(0.0)
        ).alias("coverage_percent"),
    )


def pending_tone(turns: DataFrame, windows: DataFrame, n: int = 80) -> DataFrame:
    """The next turns and windows to score, newest first."""
    columns = ["conversation_id", "start_message_id", "end_message_id", "end_at", "text"]
    queue = (
        turns.filter("positive is null")
        .select(F.lit("turn").alias("kind"), *columns)
        .unionByName(
            windows.filter("positive is null").select(F.lit("window").alias("kind"), *columns)
        )
    )
    return queue.orderBy(
        F.col("end_at").desc_nulls_last(),
        F.col("start_message_id").desc(),
        F.col("conversation_id"),
        F.col("kind"),
    ).limit(n)
