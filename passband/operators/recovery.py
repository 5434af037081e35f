"""Recordings to packets: synchronise, derandomise, screen, check frames, assemble, in that order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.operators import coding, markers, packets
from passband.operators import frames as tm
from passband.operators.frames import FrameLayout
from passband.operators.markers import KEYS
from passband.session import pin

#: Status of a frame whose code block is damaged; such a frame is dropped, not guessed at.
DAMAGED = "rs_uncorrectable"


@dataclass(frozen=True)
class CodingLayer:
    """What lies around a frame on the wire.  Without ``parity`` a block is the frame itself."""

    randomised: bool = False
    parity: int | None = None
    interleave: int = 1

    def block_octets(self, frame_octets: int) -> int:
        if self.parity is None:
            return frame_octets
        room = (coding.CODEWORD - self.parity) * self.interleave
        if frame_octets > room:
            raise ValueError(f"a frame of {frame_octets} octets does not fit a block's {room}")
        return coding.CODEWORD * self.interleave


def recovered_frames(
    chunks: DataFrame,
    frame_octets: int,
    layout: FrameLayout,
    layer: CodingLayer = CodingLayer(),
    *,
    chunk_octets: int,
    keys: Sequence[str] = KEYS,
    bit_slip: bool = False,
) -> DataFrame:
    """Frames of recordings with their ``status``: the first check that failed, or ``ok``."""
    cut = cut_blocks(chunks, layer.block_octets(frame_octets), chunk_octets=chunk_octets, keys=keys, bit_slip=bit_slip)
    return block_frames(cut, frame_octets, layout, layer)


def cut_blocks(
    chunks: DataFrame, length: int, *, chunk_octets: int, keys: Sequence[str] = KEYS, bit_slip: bool = False
) -> DataFrame:
    """Blocks of ``length`` octets behind the markers of recordings, as ``frame``; nothing in them is read."""
    totals = chunks.groupBy(*keys).agg(F.max(F.col("offset") + F.length("bytes")).alias("total"))
    starts = markers.frame_starts(markers.scan(chunks, bit_slip=bit_slip), totals, length, keys=keys)
    cells = chunks.select(*keys, F.col("chunk_no").alias("cell"), F.col("offset").alias("start"), F.col("bytes").alias("octets"))
    return markers.cut_frames(cells, starts, length, chunk_octets, keys=keys)


def block_frames(cut: DataFrame, frame_octets: int, layout: FrameLayout, layer: CodingLayer) -> DataFrame:
    """The frames in blocks that were cut, with their ``status``.

    The randomiser lies outside the code, so it comes off the whole block, check symbols included,
    before the block is screened.  Its sequence is a code word itself: a block that is not
    derandomised screens clean and only fails as a frame.
    """
    if layer.randomised:
        cut = cut.withColumn("frame", coding.derandomise("frame"))
    if layer.parity is None:
        return tm.parse(cut, layout)
    screened = coding.screened(cut, block="frame", parity=layer.parity, interleave=layer.interleave)
    inside = pin(screened.withColumn("frame", F.substring("frame", 1, frame_octets)))
    parsed = tm.parse(inside, layout)
    return parsed.withColumn("status", F.when(F.col("dirty"), DAMAGED).otherwise(F.col("status")))


def recovered_packets(frames: DataFrame, *, keys: Sequence[str] = ("capture_id", "epoch")) -> DataFrame:
    """Packets of the frames that passed, with header fields; idle fill left out."""
    passed = frames.filter(F.col("status") == "ok")
    whole = packets.header(packets.segment_packets(packets.segments(pin(passed), keys=keys), keys))
    return whole.filter(~F.coalesce(packets.is_idle(F.col("apid")), F.lit(False)))
