"""TM transfer frames: header projection and the validity filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.functions.bits import unsigned
from passband.functions.checksum import crc16
from passband.operators.channels import NO_PACKET_START, ONLY_IDLE_DATA

HEADER_BYTES = 6
OCF_BYTES = 4
FECF_BYTES = 2


@dataclass(frozen=True)
class FrameLayout:
    """What a mission put in its frames; a frame does not say."""

    has_fecf: bool = False
    has_ocf: bool = False
    insert_zone: int = 0

    def __post_init__(self) -> None:
        if self.insert_zone < 0:
            raise ValueError(f"insert_zone is {self.insert_zone}: a zone has no negative length")


#: Header fields: name -> (bit offset, bits).
HEADER = {
    "version": (0, 2),
    "scid": (2, 10),
    "vcid": (12, 3),
    "ocf_flag": (15, 1),
    "mc_count": (16, 8),
    "vc_count": (24, 8),
    "secondary_flag": (32, 1),
    "sync_flag": (33, 1),
    "order_flag": (34, 1),
    "segment_id": (35, 2),
    "fhp": (37, 11),
}


def project(frames: DataFrame, layout: FrameLayout, *, frame: str = "frame") -> DataFrame:
    """Header columns, the four optional fields and the data field of each frame."""
    b = F.col(frame)
    fields = {n: unsigned(b, at, bits).cast("int") for n, (at, bits) in HEADER.items()}
    headed = frames.withColumns(fields).withColumn("frame_bytes", F.length(b))

    second = HEADER_BYTES + layout.insert_zone
    marker = F.col("secondary_flag") == 1
    declared = unsigned(b, 8 * second, 8).bitwiseAND(F.lit(0x3F)) + 1
    has_ocf = F.lit(layout.has_ocf) & (F.col("ocf_flag") == 1)
    fecf = FECF_BYTES if layout.has_fecf else 0
    sized = headed.withColumns(
        {
            "_second": F.when(marker, F.coalesce(declared, F.lit(0))).otherwise(0).cast("int"),
            "_trailer": F.when(has_ocf, OCF_BYTES + fecf).otherwise(fecf),
        }
    )
    start = F.lit(second) + F.col("_second")
    end = F.col("frame_bytes") - F.col("_trailer")
    ocf_start = F.col("frame_bytes") - fecf - OCF_BYTES
    return sized.withColumns(
        {
            "insert_zone": F.substring(b, HEADER_BYTES + 1, layout.insert_zone)
            if layout.insert_zone
            else F.lit(None).cast("binary"),
            "secondary_header": F.when(
                marker, F.substring(b, F.lit(second + 1), F.col("_second"))
            ),
            "data": F.substring(b, start + 1, F.greatest(end - start, F.lit(0))),
            "ocf": F.when(
                has_ocf & (ocf_start >= 0), F.substring(b, ocf_start + 1, F.lit(OCF_BYTES))
            ),
            "fecf": F.when(
                F.col("frame_bytes") >= FECF_BYTES,
                F.conv(F.hex(F.substring(b, -FECF_BYTES, FECF_BYTES)), 16, 10).cast("bigint"),
            )
            if layout.has_fecf
            else F.lit(None).cast("bigint"),
        }
    )


def with_status(projected: DataFrame, layout: FrameLayout, *, frame: str = "frame") -> DataFrame:
    """The first check a frame fails, or ``ok``.

    The order is that in which one failure makes the next check meaningless: length, version,
    length again, secondary header, checksum, pointer.
    """
    size = F.col("frame_bytes")
    fixed = (
        F.lit(HEADER_BYTES + layout.insert_zone) + F.col("_trailer") + F.col("secondary_flag")
    )
    available = F.greatest(
        size - HEADER_BYTES - layout.insert_zone - F.col("_trailer"), F.lit(0)
    )
    short_second = (F.col("secondary_flag") == 1) & (F.col("_second") < 2)
    status = (
        F.when(size < HEADER_BYTES, "too_short")
        .when(F.col("version") != 0, "bad_version")
        .when(size < fixed, "too_short")
        .when(short_second | (F.col("_second") > available), "bad_secondary_header")
    )
    checked = projected
    if layout.has_fecf:
        covered = F.expr(f"substring({frame}, 1, greatest(length({frame}) - {FECF_BYTES}, 0))")
        checked = checked.withColumn("_crc", crc16(covered))
        status = status.when(F.col("_crc") != F.col("fecf"), "bad_checksum")
    pointed = (F.col("sync_flag") == 0) & ~F.col("fhp").isin(ONLY_IDLE_DATA, NO_PACKET_START)
    status = status.when(pointed & (F.col("fhp") >= F.length("data")), "bad_pointer")
    return checked.withColumn("status", status.otherwise("ok")).drop("_crc", "_second", "_trailer")


def parse(frames: DataFrame, layout: FrameLayout, *, frame: str = "frame") -> DataFrame:
    return with_status(project(frames, layout, frame=frame), layout, frame=frame)
