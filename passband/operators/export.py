"""Recordings of back-to-back packets exported as CSV, with a summary, in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from passband.functions import text
from passband.operators import packets, stream_split
from passband.operators.chunks import KEYS
from passband.operators.decommutate import Clock, Decommutator
from passband.session import small_methods
from passband.sources import exports


@dataclass(frozen=True)
class Summary:
    """What an export wrote: packets read, rows written, packets refused, and whether a recording
    ended inside a packet."""

    packets: int
    rows: int
    rejected: int
    truncated: bool


def packet_rows(chunks: DataFrame, keys: Sequence[str] = KEYS, *, max_length: int = packets.LONGEST_PACKET) -> DataFrame:
    """Packets of recordings without idle fill, and one row without octets per recording that ends
    inside a packet (``cut_off``)."""
    whole, residuals = stream_split.split(chunks, keys=keys, max_length=max_length)
    names = [*keys, "offset", "received", "bytes"]
    read = packets.header(whole.select(*names))
    kept = read.filter(~F.coalesce(packets.is_idle(F.col("apid")), F.lit(False))).withColumn("cut_off", F.lit(False))
    tails = residuals.filter(F.col("reason") == "cut_off").select(*keys, "offset").withColumn("cut_off", F.lit(True))
    return kept.unionByName(tails, allowMissingColumns=True)


def export(
    chunks: DataFrame,
    decoder: Decommutator,
    path: str,
    *,
    keys: Sequence[str] = KEYS,
    clock: Clock | None = None,
    wanted: Sequence[str] | None = None,
    max_length: int = packets.LONGEST_PACKET,
) -> Summary:
    """Split, decode and write whole recordings; the summary is observed while the rows are written.

    Refused packets are counted and have no rows.  ``wanted`` leaves out all other parameters.
    """
    rows = packet_rows(chunks, keys, max_length=max_length)
    stamped = rows.withColumn("received_ns", F.unix_micros(F.col("received").cast("timestamp")) * 1000)
    decoded = decoder.decode(stamped, clock, wanted, form=text.value_parts)
    whole = ~F.col("cut_off")
    seen = Observation()
    observed = decoded.observe(
        seen,
        F.count(F.when(whole, 1)).alias("packets"),
        F.coalesce(F.sum(F.when(whole & F.col("reason").isNull(), F.size("samples")).cast("bigint")), F.lit(0)).alias("rows"),
        F.count(F.when(whole & F.col("reason").isNotNull(), 1)).alias("rejected"),
        F.count(F.when(~whole, 1)).alias("cut_off"),
    )
    lines = exports.packet_lines(observed.filter(whole & F.col("reason").isNull()))
    with small_methods(chunks.sparkSession):
        exports.write_csv(lines, path)
    found = seen.get
    return Summary(found["packets"], found["rows"], found["rejected"], found["cut_off"] > 0)
