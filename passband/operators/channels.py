"""Virtual channels of a frame log: continuity, routing, first notices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passband.operators.ordered import DEFAULT_WIDTH, carry

FRAME_COUNT_MODULUS = 256
ONLY_IDLE_DATA = 0x7FE
NO_PACKET_START = 0x7FF


def with_continuity(
    frames: DataFrame, *, keys: Sequence[str] = ("vcid",), width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Whether each frame continues its channel, and how many frames the count says are gone.

    The first frame of a channel is not contiguous and misses nothing; a repeated count reads
    as 255 missing.  Idle and access-service frames advance the count like any other, so pass
    every frame that parsed.
    """
    ordered = carry(frames, keys, "frame_no", previous={"prev_count": "vc_count"}, width=width)
    missing = F.pmod(F.col("vc_count") - F.col("prev_count") - 1, F.lit(FRAME_COUNT_MODULUS))
    return ordered.withColumns(
        {
            "contiguous": F.coalesce(missing == 0, F.lit(False)),
            "missing": F.coalesce(missing, F.lit(0)).cast("int"),
        }
    )


def route(sync_flag: Column, pointer: Column) -> Column:
    """What becomes of a frame's data field."""
    return (
        F.when(sync_flag == 1, "access_service")
        .when(pointer == ONLY_IDLE_DATA, "idle")
        .when(pointer == NO_PACKET_START, "continuation")
        .otherwise("start")
    )


def first_access_service(frames: DataFrame, keys: Sequence[str] = ("vcid",)) -> DataFrame:
    """The one notice per channel that its data is not packets."""
    return (
        frames.filter(F.col("sync_flag") == 1)
        .groupBy(*keys)
        .agg(
            F.min("frame_no").alias("frame_no"),
            F.min_by("received", "frame_no").alias("received"),
        )
    )
