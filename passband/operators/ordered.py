"""Ordered computations that stay parallel inside one key.

Gap detection, run collapse and running totals all read rows *in arrival order* within a key
(an APID, a virtual channel, the whole log).  ``Window.partitionBy(key)`` hands every row of a
key to one task, and a single APID may be a third of the archive.  Here the arrival ordinal is
cut into fixed *slices*: at most ``width`` ordinals each, so a (key, slice) group is bounded
however hot the key is.  What crosses a slice boundary -- the last value, the total so far, the
highest mark so far -- is aggregated per slice (map-side partial aggregation, a few bytes per
slice), scanned over the slices of a key, and joined back on (key, slice), which is the
partitioning the local window needs anyway.

The answer is exactly that of the unsliced window, for any width.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passband.functions.bits import floor_div

#: Ordinals per slice.  A million rows sort inside one task's memory; an archive of 10^13
#: packets has 10^7 slices, whose totals are scanned per key in well under a task.
DEFAULT_WIDTH = 1 << 20

SLICE = "_slice"


def slice_of(order: str, width: int = DEFAULT_WIDTH) -> Column:
    """The slice an arrival ordinal falls in (floor division, also for negatives)."""
    if width < 1:
        raise ValueError(f"slice width must be at least 1, got {width}")
    return floor_div(F.col(order), width).cast("bigint")


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    previous: Mapping[str, str] | None = None,
    sums: Mapping[str, Column] | None = None,
    highs: Mapping[str, Column] | None = None,
    highs_before: Mapping[str, Column] | None = None,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Add values carried along ``order`` within ``keys``.

    ``previous``: new column -> column whose value on the preceding row is wanted
    (null on the first row of a key).
    ``sums``: new column -> expression; running total up to and including the row.
    ``highs``: new column -> expression; greatest non-null value up to and including the row;
    ``highs_before``: the same, the row itself left out.
    """
    previous, sums, highs = previous or {}, sums or {}, highs or {}
    highs_before = highs_before or {}
    marks = {**highs, **highs_before}
    # A caller that chains carries adds the slice once, so that they share one partitioning.
    base = df if SLICE in df.columns else df.withColumn(SLICE, slice_of(order, width))
    group = [*keys, SLICE]

    # One narrow pass over the input: the state each slice hands to the next one.
    edges = base.groupBy(*group).agg(
        *[F.max_by(F.col(c), F.col(order)).alias(f"_p_{n}") for n, c in previous.items()],
        *[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()],
        *[F.max(e).alias(f"_h_{n}") for n, e in marks.items()],
    )
    along = Window.partitionBy(*keys).orderBy(SLICE)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *group,
        *[F.lag(f"_p_{n}").over(along).alias(f"_p_{n}") for n in previous],
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums],
        *[F.max(f"_h_{n}").over(before).alias(f"_h_{n}") for n in marks],
    )

    local = Window.partitionBy(*group).orderBy(order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = base.join(carried, group, "left")
    columns = [F.col(c) for c in df.columns]  # keeps the slice where the caller added it
    if previous:
        first = F.row_number().over(local) == 1
        columns += [
            F.when(first, F.col(f"_p_{n}")).otherwise(F.lag(c).over(local)).alias(n)
            for n, c in previous.items()
        ]
    columns += [
        (F.coalesce(F.sum(e).over(upto), F.lit(0)) + F.coalesce(f"_s_{n}", F.lit(0))).alias(n)
        for n, e in sums.items()
    ]
    # greatest() skips nulls, so a slice with no mark of its own keeps the carried one.
    columns += [
        F.greatest(F.max(e).over(upto), F.col(f"_h_{n}")).alias(n) for n, e in highs.items()
    ]
    past = local.rowsBetween(Window.unboundedPreceding, -1)
    columns += [
        F.greatest(F.max(e).over(past), F.col(f"_h_{n}")).alias(n)
        for n, e in highs_before.items()
    ]
    return out.select(*columns)


def newest(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    depth: int,
    *,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """The newest ``depth`` rows of every key, exactly, without sorting whole keys.

    Per-slice counts (partial aggregation) say from which slice on a key already has ``depth``
    rows; older slices are dropped before anything is ranked, so a ranking group holds at most
    ``depth + width`` rows.
    """
    base = df.withColumn(SLICE, slice_of(order, width))
    group = [*keys, SLICE]
    back = Window.partitionBy(*keys).orderBy(F.desc(SLICE))
    newer = back.rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        base.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
        .filter(F.col("_newer") < depth)
        .select(*group)
    )
    rank = Window.partitionBy(*keys).orderBy(F.desc(order))
    return (
        base.join(needed, group, "left_semi")
        .withColumn("_rank", F.row_number().over(rank))
        .filter(F.col("_rank") <= depth)
        .select(*df.columns)
    )
