"""Long time series reduced for plotting.

A series is (keys, seq_no, t, v) in arrival order.  Everything that looks at all points of a
series is a grouped aggregation; only points already bounded by a drawing budget are handed to one
group as a whole.  Whole series are reduced in :mod:`passband.operators.simplify`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passband.functions.bits import floor_div
from passband.operators.lookup import dimension
from passband.operators.ordered import DEFAULT_WIDTH, carry

KEYS = ("parameter",)
RATIO = 4
MIN_BUDGET, DEFAULT_BUDGET, MAX_BUDGET = 64, 1024, 16_384
EMPTY_WINDOW_SECONDS = 60.0


def budget(points: int) -> int:
    return max(MIN_BUDGET, min(MAX_BUDGET, points))


def select_window(
    points: DataFrame, low: float | None, high: float | None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Points with low <= t <= high, and one anchor outside each end, per series.

    ``None`` selects everything; an inverted or NaN window nothing.  The anchors are two
    aggregates, so no series is sorted, and the range test reaches the scan.
    """
    if low is None or high is None:
        return points
    if math.isnan(low) or math.isnan(high) or high < low:
        return points.filter(F.lit(False))
    t = F.col("t")
    before, after = F.when(t < low, F.col("seq_no")), F.when(t > high, F.col("seq_no"))
    ends = points.groupBy(*keys).agg(
        F.struct(
            F.max(before).alias("seq_no"), F.max_by("t", before).alias("t"), F.max_by("v", before).alias("v")
        ).alias("_a"),
        F.struct(
            F.min(after).alias("seq_no"), F.min_by("t", after).alias("t"), F.min_by("v", after).alias("v")
        ).alias("_b"),
    )
    anchors = ends.select(*keys, F.inline(F.array("_a", "_b"))).filter(F.col("seq_no").isNotNull())
    inside = points.filter((t >= low) & (t <= high))
    return inside.select(*keys, "seq_no", "t", "v").unionByName(anchors)


def follow_window(points: DataFrame, now: Column) -> DataFrame:
    """[first, last] over all series; the last minute when there is nothing, or no width."""
    held = points.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    high = F.coalesce(hi, now)
    low = F.when(hi > lo, lo).otherwise(high - EMPTY_WINDOW_SECONDS)
    return held.select(low.alias("low"), high.alias("high"))


def indexed(
    points: DataFrame, keys: Sequence[str] = KEYS, *, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Add ``idx`` (0-based place in the series) and ``n`` (its length)."""
    placed = carry(points, keys, "seq_no", sums={"_k": F.lit(1)}, width=width)
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # One row per series, checked and broadcast: joining by key would gather a long series.
    return placed.withColumn("idx", F.col("_k") - 1).drop("_k").join(dimension(counts), list(keys))


def bucket_of(idx: Column, every: Column) -> Column:
    """The bucket b with trunc(b * every) <= idx < trunc((b + 1) * every), in doubles throughout."""
    guess = F.floor(idx / every)

    def starts(b: Column) -> Column:
        return F.floor(b * every)

    return (
        F.when(starts(guess) > idx, guess - 1).when(starts(guess + 1) <= idx, guess + 1).otherwise(guess)
    )


def min_max(
    placed: DataFrame, threshold: int, ratio: int = RATIO, keys: Sequence[str] = KEYS
) -> DataFrame:
    """First minimum and first maximum of every bucket, the two ends of the series around them.

    A point that is an end and an extreme appears as both, like in the sequence the next stage
    is defined over.  A NaN is an extreme only if its bucket starts with it.
    """
    ratio = max(ratio, 1)
    buckets = max(threshold - 2, 1) * ratio
    every = F.col("n") / F.lit(float(buckets))
    v = F.col("v")
    bucketed = placed.withColumn("bucket", bucket_of(F.col("idx"), every)).filter(
        F.col("bucket") < buckets
    )
    point = F.struct("idx", "seq_no", "t", "v")
    extremes = (
        bucketed.groupBy(*keys, "bucket")
        .agg(
            F.min_by(point, "idx").alias("_first"),
            F.min_by(point, F.struct("v", "idx")).alias("_low"),
            F.max_by(point, F.struct(F.when(~F.isnan(v), v), -F.col("idx"))).alias("_high"),
        )
        .withColumn("_stuck", F.isnan("_first.v"))
    )
    low = F.when(F.col("_stuck"), F.col("_first")).otherwise(F.col("_low"))
    high = F.when(F.col("_stuck"), F.col("_first")).otherwise(F.col("_high"))
    kept = extremes.select(*keys, F.explode(F.array_distinct(F.array(low, high))).alias("_p"))
    inner = kept.select(*keys, F.lit(1).alias("part"), "_p.*")
    ends = placed.filter((F.col("idx") == 0) | (F.col("idx") == F.col("n") - 1))
    outer = ends.select(
        *keys,
        F.explode(
            F.when(F.col("n") == 1, F.array(F.lit(0), F.lit(2)))
            .when(F.col("idx") == 0, F.array(F.lit(0)))
            .otherwise(F.array(F.lit(2)))
        ).alias("part"),
        "idx",
        "seq_no",
        "t",
        "v",
    )
    return inner.unionByName(outer)


def lttb_indices(t: np.ndarray, v: np.ndarray, threshold: int) -> np.ndarray:
    """Positions largest-triangle-three-buckets keeps; the first of equal areas wins."""
    n = len(t)
    if threshold >= n:
        return np.arange(n)
    if threshold < 3:
        return np.array([0, n - 1][: min(n, 2)])
    x = t - t[0]
    every = (n - 2) / (threshold - 2)
    kept, anchor = [0], 0
    with np.errstate(invalid="ignore", over="ignore"):
        for i in range(threshold - 2):
            a, b = int((i + 1) * every) + 1, min(int((i + 2) * every) + 1, n)
            if b > a:
                ahead_t = np.cumsum(x[a:b])[-1] / (b - a)
                ahead_v = np.cumsum(v[a:b])[-1] / (b - a)
            else:
                ahead_t, ahead_v = x[-1], v[-1]
            start, end = int(i * every) + 1, min(int((i + 1) * every) + 1, n)
            area = np.abs(
                (x[anchor] - ahead_t) * (v[start:end] - v[anchor])
                - (x[anchor] - x[start:end]) * (ahead_v - v[anchor])
            )
            anchor = start + int(np.argmax(np.where(np.isnan(area), -1.0, area)))
            kept.append(anchor)
    kept.append(n - 1)
    return np.array(kept)


def _per_series(rows: DataFrame, threshold: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    names = [*keys, "seq_no", "t", "v"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)
    columns = [f.name for f in rows.schema if f.name in names]

    def reduce_one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        kept = lttb_indices(pdf["t"].to_numpy(), pdf["v"].to_numpy(), threshold)
        return pdf.iloc[kept][columns]

    return rows.groupBy(*keys).applyInPandas(reduce_one, schema)


def min_max_lttb(
    points: DataFrame,
    threshold: int,
    ratio: int = RATIO,
    keys: Sequence[str] = KEYS,
    *,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """At most ``threshold`` points per series, chosen among the extremes of ``ratio`` times as many buckets.

    What one group sees is bounded by the budget, never by the length of the series.
    """
    placed = indexed(points, keys, width=width)
    if threshold < 3:
        ends = (F.col("idx") == 0) | (F.col("idx") == F.col("n") - 1)
        return placed.filter(ends | (F.col("n") <= threshold)).select(*keys, "seq_no", "t", "v")
    few = (F.col("n") <= threshold) | (F.col("n") <= threshold * max(ratio, 1))
    small = placed.filter(few).withColumn("part", F.lit(1)).drop("n")
    large = min_max(placed.filter(~few), threshold, ratio, keys)
    return _per_series(small.unionByName(large, allowMissingColumns=True), threshold, keys, ["part", "idx"])


def plot_grid(
    history: DataFrame,
    members: DataFrame,
    *,
    points: int = DEFAULT_BUDGET,
    low: float | None = None,
    high: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(considered, drawn) points per plot member: window first, then reduction to the budget."""
    keys = ("plot_no", "ordinal", "parameter")
    series = history.select("parameter", "seq_no", "t", "v").join(dimension(members), "parameter")
    considered = select_window(series.select(*keys, "seq_no", "t", "v"), low, high, keys)
    return considered, min_max_lttb(considered, budget(points), RATIO, keys)


def accounting(
    considered: DataFrame, drawn: DataFrame, keys: Sequence[str] = ("plot_no",)
) -> DataFrame:
    """Points before and after reduction."""
    before = considered.groupBy(*keys).agg(F.count(F.lit(1)).alias("considered"))
    after = drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("drawn"))
    return before.join(after, list(keys), "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
