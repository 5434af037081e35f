"""CSP messages: header projection, refusals, checksum, payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.functions.bits import unsigned
from passband.functions.checksum import crc32c

# Field positions (bit offset, bits) per header version, and flag bits.
LAYOUTS = {
    1: {
        "priority": (0, 2),
        "source": (2, 5),
        "destination": (7, 5),
        "destination_port": (12, 6),
        "source_port": (18, 6),
        "flags": (24, 8),
    },
    2: {
        "priority": (0, 2),
        "destination": (2, 14),
        "source": (16, 14),
        "destination_port": (30, 6),
        "source_port": (36, 6),
        "flags": (42, 6),
    },
}
HEADER_BYTES = {1: 4, 2: 6}
FRAGMENT, HMAC, XTEA, RDP, CRC32 = 0x10, 0x08, 0x04, 0x02, 0x01
CRC_BYTES = 4


def parse(messages: DataFrame, version: int = 1, *, octets: str = "bytes") -> DataFrame:
    """Header columns, ``status`` (the first refusal, or ok) and ``payload`` (null if refused).

    The checksum may cover header and payload, or the payload alone.
    """
    if version not in LAYOUTS:
        raise ValueError(f"no such header version: {version}")
    b, head = F.col(octets), HEADER_BYTES[version]
    size = F.length(b)
    fields = {
        n: F.when(size >= head, unsigned(b, at, bits)).cast("int")
        for n, (at, bits) in LAYOUTS[version].items()
    }
    split = F.greatest(size - CRC_BYTES, F.lit(head))
    parsed = messages.withColumns(fields).withColumns(
        {
            "_whole": crc32c(F.substring(b, F.lit(1), split)),
            "_bare": crc32c(F.substring(b, F.lit(head + 1), split - head)),
            "_found": F.conv(F.hex(F.substring(b, split + 1, F.lit(CRC_BYTES))), 16, 10).cast("bigint"),
        }
    )

    def flagged(bit: int):
        return F.col("flags").bitwiseAND(F.lit(bit)) != 0

    status = F.when(size < head, "too_short").when(flagged(HMAC), "hmac")
    if version == 1:
        status = status.when(flagged(XTEA), "encryption")
    checked = flagged(CRC32)
    status = (
        status.when(flagged(FRAGMENT), "fragmentation")
        .when(flagged(RDP), "rdp")
        .when(checked & (size < head + CRC_BYTES), "too_short")
        .when(
            checked & (F.col("_found") != F.col("_whole")) & (F.col("_found") != F.col("_bare")),
            "bad_checksum",
        )
        .otherwise("ok")
    )
    end = F.when(checked, split).otherwise(size)
    return (
        parsed.withColumn("status", status)
        .withColumn(
            "payload",
            F.when(F.col("status") == "ok", F.substring(b, F.lit(head + 1), end - head)),
        )
        .drop("_whole", "_bare", "_found")
    )
