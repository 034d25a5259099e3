"""Tone score columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORES = ("negative", "neutral", "positive", "valence", "confidence")


def tone_from_logits(negative: Column, neutral: Column, positive: Column) -> Column:
    """Softmax shifted by the largest logit, with valence and confidence."""
    top = F.greatest(negative, neutral, positive)
    exps = [F.exp(x - top) for x in (negative, neutral, positive)]
    total = exps[0] + exps[1] + exps[2]
    shares = [x / total for x in exps]
    return F.struct(
        shares[0].alias("negative"),
        shares[1].alias("neutral"),
        shares[2].alias("positive"),
        (shares[2] - shares[0]).alias("valence"),
        F.greatest(*shares).alias("confidence"),
    )


def dominant(negative: Column, neutral: Column, positive: Column) -> Column:
    """Negative wins every tie, neutral wins against positive."""
    return (
        F.when((negative >= neutral) & (negative >= positive), F.lit("negative"))
        .when((neutral > negative) & (neutral >= positive), F.lit("neutral"))
        .when((positive > negative) & (positive > neutral), F.lit("positive"))
    )


def round4(value: Column) -> Column:
    return F.round(value, 4)
