"""Packet error control and the service header of telemetry packets (ECSS-E-ST-70-41C)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.functions.bits import unsigned
from passband.functions.checksum import crc16
from passband.operators.packets import header

# The telemetry secondary header behind the primary one (bit offset, bits).
SECONDARY = {
    "pus_version": (48, 4),
    "time_status": (52, 4),
    "service": (56, 8),
    "subtype": (64, 8),
    "msg_counter": (72, 16),
    "destination": (88, 16),
    "coarse_seconds": (104, 32),
    "fine_seconds": (136, 16),
}
PUS_VERSION_C = 2
SHORTEST = 21


def audit(packets: DataFrame, *, octets: str = "bytes") -> DataFrame:
    """Checksum residue of every packet, its service fields, and the first check it fails.

    The checksum runs over the packet with its own two octets included and leaves zero.
    """
    b = F.col(octets)
    headed = header(packets, octets=octets).withColumns(
        {n: unsigned(b, at, bits) for n, (at, bits) in SECONDARY.items()}
    )
    flagged = headed.withColumns(
        {
            "crc_ok": (F.length(b) >= 2) & (crc16(b) == 0),
            "secondary_flag": unsigned(b, 4, 1).cast("int"),
        }
    )
    status = (
        F.when((F.length(b) < SHORTEST) | (F.length(b) != F.col("declared_length")), "bad_length")
        .when(F.col("secondary_flag") == 0, "no_secondary_header")
        .when(~F.col("crc_ok"), "bad_crc")
        .when(F.col("pus_version") != PUS_VERSION_C, "bad_version")
        .otherwise("ok")
    )
    return flagged.withColumn("status", status)


def service_rollup(
    audited: DataFrame, keys: Sequence[str] = ("apid", "service", "subtype")
) -> DataFrame:
    """Packets and checksum failures per service."""
    bad = F.count(F.when(~F.col("crc_ok"), 1))
    return audited.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"),
        bad.alias("bad_crc"),
        (bad / F.count(F.lit(1))).alias("bad_crc_rate"),
    )
