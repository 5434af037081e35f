"""Operator limits against samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.functions.predicates import limit_state
from passband.operators.lookup import dimension

BOUNDS = ("warning_low", "warning_high", "alarm_low", "alarm_high")


def with_state(samples: DataFrame, limits: DataFrame, number: str = "eng") -> DataFrame:
    """Add ``state`` (0..3).  A parameter without an entry, or without a number, is unknown."""
    joined = samples.join(dimension(limits.select("parameter", *BOUNDS)), "parameter", "left")
    state = limit_state(F.col(number), *[F.col(b) for b in BOUNDS])
    return joined.withColumn("state", state).drop(*BOUNDS)


def worst(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    return states.groupBy(*keys).agg(F.max("state").alias("worst"))
