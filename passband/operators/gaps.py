"""Packet sequence counts: gaps, probe tallies, dropout sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.operators.ordered import DEFAULT_WIDTH, carry
from passband.session import pin

SEQUENCE_MODULUS = 16384
APID_COUNT = 2048
#: Gaps folded between two running totals, and contiguous packets that end a dropout.
GAP_SUMMARY_INTERVAL = 64
HEALTHY_RUN = 64

KEYS = ("epoch", "apid")


def with_missed(
    packets: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    width: int = DEFAULT_WIDTH,
    repeat_is_gap: bool = False,
) -> DataFrame:
    """Packets missed before each packet of its APID, in arrival order.

    A repeated count is 0 missed, unless ``repeat_is_gap`` (the probe's reading: one gap of
    16 383).  Adds ``rn``, the arrival ordinal inside the key, and ``missed``.  Rows without an
    APID, or with one above eleven bits, are never tracked and are left out.
    """
    tracked = packets.filter(F.col("apid").isNotNull() & (F.col("apid") < APID_COUNT)).withColumn(
        "_seq", F.col("seq_count") % SEQUENCE_MODULUS
    )
    ordered = carry(
        tracked, keys, "pkt_no", previous={"_prev": "_seq"}, sums={"rn": F.lit(1)}, width=width
    )
    step = F.pmod(F.col("_seq") - F.col("_prev") - 1, F.lit(SEQUENCE_MODULUS))
    continuous = F.col("_prev").isNull()
    if not repeat_is_gap:
        continuous = continuous | (F.col("_seq") == F.col("_prev"))
    return ordered.withColumn("missed", F.when(continuous, 0).otherwise(step).cast("int")).drop(
        "_seq", "_prev"
    )


def gap_totals(missed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Gaps and missing packets, two different numbers about a link."""
    return missed.groupBy(*keys).agg(
        F.count(F.when(F.col("missed") > 0, 1)).alias("gaps"),
        F.coalesce(F.sum(F.col("missed").cast("bigint")), F.lit(0)).alias("missing"),
    )


def apid_tally(packets: DataFrame, *, width: int = DEFAULT_WIDTH) -> DataFrame:
    """The probe's table: packets, shortest, longest, gaps and missing per APID."""
    stepped = with_missed(packets, keys=("apid",), width=width, repeat_is_gap=True)
    return stepped.groupBy("apid").agg(
        F.count(F.lit(1)).alias("packets"),
        F.min("pkt_len").alias("shortest"),
        F.max("pkt_len").alias("longest"),
        F.count(F.when(F.col("missed") > 0, 1)).alias("gaps"),
        F.sum(F.col("missed").cast("bigint")).alias("missing"),
    )


def dropout_sessions(
    packets: DataFrame,
    *,
    keys: Sequence[str] = KEYS,
    width: int = DEFAULT_WIDTH,
    healthy_run: int = HEALTHY_RUN,
    summary_interval: int = GAP_SUMMARY_INTERVAL,
) -> DataFrame:
    """What the log says about gaps: the first of a dropout, running totals, and recovery.

    A dropout ends once ``healthy_run`` packets in a row were contiguous; it is then reported
    ``recovered`` at that packet with its totals.  ``rn`` is the arrival ordinal in the key.
    """
    missed = with_missed(packets, keys=keys, width=width)
    # Only the gap rows go on: they are read by four later stages, so they are written once.
    gaps = pin(missed.filter(F.col("missed") > 0).select(*keys, "rn", "seq_count", "missed"))

    totals = carry(
        gaps,
        keys,
        "rn",
        previous={"_prev_rn": "rn"},
        sums={"_gaps": F.lit(1), "_missing": F.col("missed").cast("bigint")},
        width=width,
    )
    starts = F.col("_prev_rn").isNull() | (F.col("rn") - F.col("_prev_rn") > healthy_run)
    # Totals never fall along a key, so the base of a dropout is the highest base so far.
    opened = carry(
        totals.withColumn("_starts", starts),
        keys,
        "rn",
        highs={
            "_open": F.when(F.col("_starts"), F.col("rn")),
            "_gaps0": F.when(F.col("_starts"), F.col("_gaps") - 1),
            "_missing0": F.when(F.col("_starts"), F.col("_missing") - F.col("missed")),
        },
        width=width,
    ).withColumns(
        {
            "gaps": F.col("_gaps") - F.col("_gaps0"),
            "missing": F.col("_missing") - F.col("_missing0"),
        }
    )
    said = opened.filter(F.col("_starts") | (F.col("gaps") % summary_interval == 0)).select(
        *keys,
        "rn",
        F.when(F.col("_starts"), "first").otherwise("running").alias("kind"),
        F.col("seq_count").cast("int").alias("seq_count"),
        "gaps",
        "missing",
    )
    arrived = missed.groupBy(*keys).agg(F.max("rn").alias("_arrived"))
    recovered = (
        opened.groupBy(*keys, "_open")
        .agg(
            (F.max("rn") + healthy_run).alias("rn"),
            F.max("gaps").alias("gaps"),
            F.max("missing").alias("missing"),
        )
        .join(arrived, list(keys))
        .filter(F.col("rn") <= F.col("_arrived"))
        .select(
            *keys,
            "rn",
            F.lit("recovered").alias("kind"),
            F.lit(None).cast("int").alias("seq_count"),
            "gaps",
            "missing",
        )
    )
    return said.unionByName(recovered)
