"""Recordings as octets: chunks, fixed cells, and ranges cut out of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passband.functions.bits import floor_div

KEYS = ("capture_id", "epoch")


def joined_octets(pieces: Column) -> Column:
    """The ``octets`` of sorted pieces end to end, in one step: a growing buffer would be quadratic."""
    return F.unhex(F.array_join(F.transform(pieces, lambda p: F.hex(p["octets"])), ""))


def recut(
    pieces: DataFrame, keys: Sequence[str], size: int, *, offset: str = "offset", octets: str = "octets"
) -> DataFrame:
    """Contiguous pieces of a stream re-cut at every ``size`` octets: (cell, start, octets)."""
    begin = F.col(offset)
    end = begin + F.length(octets)
    first, last = floor_div(begin, size), floor_div(end - 1, size)
    spread = pieces.filter(F.length(octets) > 0).withColumn("cell", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("cell") * size, begin)
    high = F.least((F.col("cell") + 1) * size, end)
    part = F.substring(
        F.col(octets), (low - begin + 1).cast("int"), (high - low).cast("int")
    )
    return (
        spread.select(*keys, "cell", low.alias("_at"), part.alias("octets"))
        .groupBy(*keys, "cell")
        .agg(F.sort_array(F.collect_list(F.struct("_at", "octets"))).alias("_pieces"))
        .select(
            *keys,
            "cell",
            F.col("_pieces")[0]["_at"].alias("start"),
            joined_octets(F.col("_pieces")).alias("octets"),
        )
    )


def cut(
    cells: DataFrame,
    ranges: DataFrame,
    size: int,
    *,
    keys: Sequence[str] = KEYS,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Octets of (start, length) ranges out of a recording cut into cells of ``size`` octets.

    Each range names the cells it touches, so this is an equi-join; one cell may serve many.
    """
    begin, end = F.col("start"), F.col("start") + F.col("length")
    touched = ranges.withColumn(
        "cell", F.explode(F.sequence(floor_div(begin, size), floor_div(end - 1, size)))
    )
    low = F.greatest(begin, F.col("_cell_start"))
    high = F.least(end, F.col("_cell_start") + F.length("octets"))
    held = cells.select(*keys, "cell", F.col("start").alias("_cell_start"), "octets")
    part = F.substring(
        F.col("octets"), (low - F.col("_cell_start") + 1).cast("int"), (high - low).cast("int")
    )
    group = [*keys, "start", "length", *carried]
    return (
        touched.join(held, [*keys, "cell"])
        .select(*group, "cell", part.alias("octets"))
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct("cell", "octets"))).alias("_p"))
        .select(
            *group,
            joined_octets(F.col("_p")).alias("octets"),
        )
        .filter(F.length("octets") == F.col("length"))
    )


def prefix(
    chunks: DataFrame, octets: int, *, column: str = "bytes"
) -> DataFrame:
    """The first ``octets`` of every recording: whole chunks by predicate, the last one cut."""
    if octets < 0:
        raise ValueError("a prefix has no negative length")
    kept = F.least(F.length(column), F.lit(octets) - F.col("offset")).cast("int")
    return chunks.filter(F.col("offset") < octets).withColumn(
        column, F.substring(F.col(column), F.lit(1), kept)
    )
