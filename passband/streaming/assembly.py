"""Frames to packets across micro-batches, and the losses still open when a stream ends."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from passband.operators.channels import FRAME_COUNT_MODULUS, NO_PACKET_START, ONLY_IDLE_DATA
from passband.operators.packets import LONGEST_PACKET, assemble_segment, check_max_length
from passband.streaming.ordered_input import OrderedInput

#: Frames of a channel held at once.
MOST_FRAMES = 4096
OUTPUT = "frame_no bigint, pkt_index int, received timestamp, bytes binary, lost int, discarded bigint"


class Assembler(StatefulProcessor):
    """Per channel: the last frame count and the octets of the packet in progress."""

    def __init__(self, keys: Sequence[str], max_length: int, most: int) -> None:
        self.keys, self.max_length, self.most = list(keys), max_length, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("channel", "count int, partial binary")
        self.input = OrderedInput(handle, "frame_no", self.most)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, partial = self.state.get() if self.state.exists() else (-1, b"")
        partial = bytes(partial or b"")
        for batch in self.input.read(rows):
            out: list[tuple] = []
            for frame in batch.itertuples(index=False):
                packets, count, partial, lost, discarded = self._frame(frame, count, partial)
                out += [(frame.frame_no, i, frame.received, octets, 0, 0) for i, octets in enumerate(packets)]
                if lost or discarded:
                    out.append((frame.frame_no, -1, frame.received, None, lost, discarded))
            made = pd.DataFrame(out, columns=["frame_no", "pkt_index", "received", "bytes", "lost", "discarded"])
            for name, value in zip(reversed(self.keys), reversed(key)):
                made.insert(0, name, value)
            yield made
        self.state.update((count, partial))

    def _frame(self, frame, count: int, partial: bytes) -> tuple[list[bytes], int, bytes, int, int]:
        """(packets, count, still partial, lost, discarded) after one frame of the channel."""
        packets: list[bytes] = []
        lost = discarded = 0
        if count >= 0 and (frame.vc_count - count - 1) % FRAME_COUNT_MODULUS and partial:
            lost, discarded, partial = 1, len(partial), b""
        if frame.sync_flag or frame.fhp == ONLY_IDLE_DATA:
            return packets, int(frame.vc_count), partial, lost, discarded
        data = bytes(frame.data)
        starts = frame.fhp != NO_PACKET_START
        head, rest = (data[: frame.fhp], data[frame.fhp :]) if starts else (data, b"")
        if partial:  # a segment that began with the octets held: what comes continues it
            done, more_lost, dropped, pending, _, _ = assemble_segment([partial, head], starts, self.max_length)
            packets += [p["bytes"] for p in done]
            lost, discarded = lost + more_lost, discarded + dropped
            partial = partial + head if pending else b""
        else:
            discarded += len(head)
        if starts:
            done, _, dropped, pending, _, _ = assemble_segment([rest], False, self.max_length)
            packets += [p["bytes"] for p in done]
            discarded += dropped
            partial = rest[len(rest) - pending :] if pending else b""
        return packets, int(frame.vc_count), partial, lost, discarded

    def close(self) -> None:
        pass


def assemble(
    frames: DataFrame,
    keys: Sequence[str] = ("capture_id", "epoch", "vcid"),
    *,
    max_length: int = LONGEST_PACKET,
    most: int = MOST_FRAMES,
) -> DataFrame:
    """Packets as frames arrive; rows with ``pkt_index`` -1 account for what was lost.

    A task holds at most ``most`` frames of a channel at once, whatever a micro-batch brings.
    """
    key_schema = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)
    needed = [*keys, "frame_no", "received", "vc_count", "sync_flag", "fhp", "data"]
    return frames.select(*needed).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Assembler(keys, check_max_length(max_length), most),
        outputStructType=f"{key_schema}, {OUTPUT}",
        outputMode="Append",
        timeMode="None",
    )


def still_open(spark: SparkSession, checkpoint: str) -> DataFrame:
    """At the end of a stream: every partial packet is one lost packet and its octets."""
    state = (
        spark.read.format("statestore")
        .option("path", checkpoint)
        .option("stateVarName", "channel")
        .load()
    )
    pending = F.length("value.partial")
    return state.filter(pending > 0).select("key.*", F.lit(1).alias("lost"), pending.alias("discarded"))
