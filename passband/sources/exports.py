"""CSV exports: samples, snapshot, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband import schemas
from passband.functions import text

#: RFC 4180: quote where needed, double inner quotes, keep spaces, no escape character.
CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "emptyValue": "",
    "lineSep": "\n",
}


def sample_rows(samples: DataFrame) -> DataFrame:
    """One row per decoded value.  ``time`` and ``received_ns`` are nanoseconds."""
    return samples.select(
        text.iso(F.col("time")).alias("time"),
        text.iso(F.col("received_ns")).alias("received"),
        "apid",
        "sequence",
        "parameter",
        text.value_text(F.col("raw")).alias("raw"),
        text.value_text(F.col("eng")).alias("eng"),
    ).select(*schemas.SAMPLE_EXPORT)


def packet_lines(packets: DataFrame) -> DataFrame:
    """:func:`sample_rows` of packets whose samples were decoded with ``form=text.value_parts``.

    What all samples of a packet share is written once.
    """
    stamped = packets.select(
        text.iso(F.col("time")).alias("time"),
        text.iso(F.col("received_ns")).alias("received"),
        "apid",
        "sequence",
        "samples",
    )
    samples = stamped.select("time", "received", "apid", "sequence", F.inline("samples"))
    written = {c: text.parts_text(F.col(c)) for c in ("raw", "eng")}
    return samples.withColumns(written).select(*schemas.SAMPLE_EXPORT)


def snapshot_rows(latest: DataFrame, definition: DataFrame) -> DataFrame:
    """One row per parameter ever seen: latest values with ``state``, ``updates`` and names."""
    named = definition.select("parameter", F.array_join("units", " ").alias("unit"))
    return latest.join(named, "parameter").select(
        "parameter",
        text.iso_micros(F.unix_micros(F.col("received").cast("timestamp"))).alias("time"),
        text.float_text(F.col("raw")).alias("raw"),
        text.float_text(F.col("eng")).alias("eng"),
        "unit",
        "updates",
        text.label(F.col("state"), text.LIMIT_LABELS).alias("limit"),
    ).select(*schemas.SNAPSHOT_EXPORT)


def history_rows(history: DataFrame) -> DataFrame:
    """Retained points, parameter by parameter, oldest first (a range-partitioned sort)."""
    return history.orderBy("parameter", "seq_no").select(
        "parameter",
        text.iso_micros(F.floor(F.col("t") * 1e6).cast("bigint")).alias("time"),
        text.float_text(F.col("v")).alias("value"),
    )


def csv_schema(columns: Sequence[str]) -> str:
    """All columns of an export as text, for reading it back."""
    return ", ".join(f"`{c}` string" for c in columns)


def write_csv(rows: DataFrame, path: str) -> None:
    """Partitioned write; nothing passes through the driver."""
    rows.write.mode("overwrite").options(**CSV).csv(path)
