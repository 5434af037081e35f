"""Event lines: collapse of repeats, filters, the merged log."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passband.functions.predicates import contains_ascii_fold
from passband.operators.ordered import DEFAULT_WIDTH, carry

LINE = ("severity", "source", "message")
DEFAULT_CAPACITY = 2048


def collapse(
    events: DataFrame, *, keys: Sequence[str] = (), width: int = DEFAULT_WIDTH
) -> DataFrame:
    """One row per run of equal lines: its first ordinal, latest time and count."""
    before = {f"_{c}": c for c in LINE}
    stepped = carry(events, keys, "seq_no", previous=before, width=width)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LINE])
    # The first line of a log differs from "nothing": its severity is compared with null.
    marked = stepped.withColumn("_starts", F.when(~same, F.col("seq_no"))).drop(*before)
    runs = carry(marked, keys, "seq_no", highs={"run": F.col("_starts")}, width=width)
    return runs.groupBy(*keys, "run", *LINE).agg(
        F.max_by("event_time", "seq_no").alias("event_time"),
        F.count(F.lit(1)).alias("repeats"),
    )


def newest_runs(runs: DataFrame, capacity: int = DEFAULT_CAPACITY) -> DataFrame:
    """The newest ``capacity`` runs of one log (a top-k, never a whole sort)."""
    return runs.orderBy(F.desc("run")).limit(capacity)


def totals(runs: DataFrame, capacity: int = DEFAULT_CAPACITY) -> DataFrame:
    """Lines held and pushes including repeats."""
    return runs.agg(
        F.least(F.count(F.lit(1)), F.lit(capacity)).alias("held"),
        F.coalesce(F.sum("repeats"), F.lit(0)).alias("total"),
    )


def visible(min_severity: int, needle: str) -> Column:
    hit = contains_ascii_fold(F.col("message"), needle) | contains_ascii_fold(F.col("source"), needle)
    return (F.col("severity") >= min_severity) & hit


def worth_saying(verbose: bool) -> Column:
    """Info lines are dropped unless asked for."""
    return F.lit(verbose) | (F.col("severity") > 0)


def merged(logs: Sequence[DataFrame]) -> DataFrame:
    """One log out of several that share a sequence; order by it when printing."""
    return reduce(lambda a, b: a.unionByName(b), logs)
