"""Link statistics, ratios, liveness and rates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passband.functions.bits import floor_div
from passband.operators.channels import ONLY_IDLE_DATA
from passband.operators.ordered import DEFAULT_WIDTH, carry
from passband.operators.packets import is_idle

#: The counters of one link, in report order.
COUNTERS = (
    "bytes_in",
    "sync_found",
    "sync_lost",
    "frames_seen",
    "frames_ok",
    "frames_dropped",
    "rs_corrected",
    "rs_symbols",
    "rs_uncorrectable",
    "crc_failures",
    "idle_frames",
    "idle_packets",
    "packets_in",
    "packets_decoded",
    "packets_rejected",
    "packets_lost",
    "sequence_gaps",
    "sequence_missing",
)

LIVE_SECONDS = 3.0
QUIET_SECONDS = 30.0
FRAME_LOSS_WARNING = 0.01
RATE_WINDOW_SECONDS = 5.0
RATE_SAMPLE_SECONDS = 0.5


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def frame_counters(frames: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The frame stage's share of the counters, from a frame log."""
    status = F.col("status")
    repaired = (F.col("rs_symbols") > 0) & (status != "rs_uncorrectable")
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames_seen"),
        _count(status == "ok").alias("frames_ok"),
        _count(status != "ok").alias("frames_dropped"),
        _count(repaired).alias("rs_corrected"),
        F.coalesce(F.sum(F.when(repaired, F.col("rs_symbols").cast("bigint"))), F.lit(0)).alias(
            "rs_symbols"
        ),
        _count(status == "rs_uncorrectable").alias("rs_uncorrectable"),
        _count(status == "bad_checksum").alias("crc_failures"),
        _count(
            (status == "ok") & (F.col("sync_flag") == 0) & (F.col("fhp") == ONLY_IDLE_DATA)
        ).alias("idle_frames"),
    )


def assembly_counters(whole: DataFrame, losses: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The packet stage's share: packets handed on, idle ones dropped, partial ones lost.

    ``whole`` are packets with their header, ``losses`` the residual rows beside them.
    """
    idle = F.coalesce(is_idle(F.col("apid")), F.lit(False))
    counted = whole.groupBy(*keys).agg(_count(~idle).alias("packets_in"), _count(idle).alias("idle_packets"))
    lost = losses.groupBy(*keys).agg(F.sum(F.col("lost").cast("bigint")).alias("packets_lost"))
    return counted.unionByName(lost, allowMissingColumns=True)


def decode_counters(decoded: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Packets the definition describes, and those it refuses."""
    fine = F.col("reason").isNull()
    return decoded.groupBy(*keys).agg(_count(fine).alias("packets_decoded"), _count(~fine).alias("packets_rejected"))


def gap_counters(missed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Breaks in sequence counts and what they leave out, and the instant of the last packet."""
    return missed.groupBy(*keys).agg(
        _count(F.col("missed") > 0).alias("sequence_gaps"),
        F.coalesce(F.sum(F.col("missed").cast("bigint")), F.lit(0)).alias("sequence_missing"),
        F.max("received").alias("last_packet"),
    )


def link_stats(stages: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Merge per-stage counters into one row per stream; a counter no stage fed is 0.

    Stage tables are already aggregated, so the union is a handful of rows per stream and needs
    no join between stages.
    """
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stages)
    held = set(merged.columns)
    aggregates = [
        (F.coalesce(F.sum(c), F.lit(0)) if c in held else F.lit(0)).cast("bigint").alias(c)
        for c in COUNTERS
    ]
    if "last_packet" in held:
        aggregates.append(F.max("last_packet").alias("last_packet"))
    return merged.groupBy(*keys).agg(*aggregates)


def frame_loss(seen: Column, dropped: Column) -> Column:
    return F.when(seen == 0, F.lit(0.0)).otherwise(dropped / seen)


def correction_depth(symbols: Column, corrected: Column) -> Column:
    return F.when(corrected == 0, F.lit(0.0)).otherwise(symbols / corrected)


def silence_seconds(now_us: Column, last_us: Column, opened_us: Column) -> Column:
    """Seconds since the last packet, or since opening while none has arrived."""
    return (now_us - F.coalesce(last_us, opened_us)) / F.lit(1e6)


def liveness(
    now_us: Column, last_us: Column, opened_us: Column, running: Column | None = None
) -> Column:
    """live, quiet or stopped.  Never live before the first packet."""
    running = F.lit(True) if running is None else running
    silent = silence_seconds(now_us, last_us, opened_us)
    return (
        F.when(~running | opened_us.isNull(), "stopped")
        .when(last_us.isNotNull() & (silent <= LIVE_SECONDS), "live")
        .when(silent <= QUIET_SECONDS, "quiet")
        .otherwise("stopped")
    )


def counter_ticks(
    arrivals: DataFrame,
    keys: Sequence[str] = (),
    *,
    at_us: str,
    length: str,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Cumulative byte and packet counters, one reading per half second that had traffic."""
    tick = floor_div(F.col(at_us), int(RATE_SAMPLE_SECONDS * 1e6))
    per_tick = arrivals.groupBy(*keys, tick.alias("tick")).agg(
        F.sum(F.col(length).cast("bigint")).alias("_bytes"), F.count(F.lit(1)).alias("_packets")
    )
    return carry(
        per_tick,
        keys,
        "tick",
        sums={"bytes": F.col("_bytes"), "packets": F.col("_packets")},
        width=width,
    ).drop("_bytes", "_packets")


def clock_segments(
    ticks: DataFrame, keys: Sequence[str], order: str, at: str, *, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Number the stretches between backward steps of the clock; rates never span one."""
    stepped = carry(ticks, keys, order, previous={"_before": at}, width=width)
    back = F.when(F.col(at) < F.col("_before"), 1).otherwise(0)
    return carry(stepped, keys, order, sums={"segment": back}, width=width).drop("_before")


def rates(ticks: DataFrame, keys: Sequence[str] = (), *, width: int = 86_400) -> DataFrame:
    """Bytes and packets per second over the readings of the last five seconds.

    Readings are cut into slices of time; the last five seconds of a slice are also sent to the
    next one, so every window is whole and no key is one task.
    """
    span = int(RATE_WINDOW_SECONDS / RATE_SAMPLE_SECONDS)
    if width <= span:
        raise ValueError("a slice must be longer than the rate window")
    home = floor_div(F.col("tick"), width)
    spread = F.when(
        F.pmod(F.col("tick"), F.lit(width)) >= width - span, F.array(home, home + 1)
    ).otherwise(F.array(home))
    placed = ticks.withColumn("_home", home).withColumn("_slice", F.explode(spread))
    recent = (
        Window.partitionBy(*keys, "_slice").orderBy("tick").rangeBetween(-span, Window.currentRow)
    )
    seconds = (F.col("tick") - F.col("_tick0")) * F.lit(RATE_SAMPLE_SECONDS)

    def rate(now: str, then: str) -> Column:
        gained = F.greatest(F.col(now) - F.col(then), F.lit(0))
        return F.when(seconds > 0, gained / seconds).otherwise(F.lit(0.0))

    return (
        placed.withColumns(
            {
                "_tick0": F.first("tick").over(recent),
                "_bytes0": F.first("bytes").over(recent),
                "_packets0": F.first("packets").over(recent),
            }
        )
        .filter(F.col("_slice") == F.col("_home"))
        .select(
            *keys,
            "tick",
            rate("bytes", "_bytes0").alias("bytes_per_second"),
            rate("packets", "_packets0").alias("packets_per_second"),
        )
    )
