"""Frame synchronisation across micro-batches; the result does not depend on chunk sizes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from passband.operators.markers import FLYWHEEL, MARKER, first_marker, shifted
from passband.streaming.ordered_input import OrderedInput

#: Chunks of a recording held at once.
MOST_CHUNKS = 256
OUTPUT = "start bigint, bit int, found boolean, received timestamp, frame binary"


def aligned(octets: bytes, bit: int) -> bytes:
    """Octets that begin ``bit`` bits into the first of those given; the last is used up for it."""
    if not bit:
        return octets
    given = np.frombuffer(octets, np.uint8)
    return (given[:-1] << bit | given[1:] >> (8 - bit)).tobytes()


class Synchroniser(StatefulProcessor):
    """Per recording: octets not used up yet, and whether and where lock is held."""

    def __init__(self, keys: Sequence[str], length: int, marker: bytes, bit_slip: bool, most: int) -> None:
        self.keys, self.length, self.marker, self.most = list(keys), length, marker, most
        self.bits = range(8) if bit_slip else range(1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "sync", "base bigint, buffer binary, locked boolean, misses int, bit int"
        )
        self.input = OrderedInput(handle, "chunk_no", self.most)

    def _at(self, buffer: bytes, at: int, bit: int) -> bool:
        value, mask = shifted(self.marker, bit)
        window = buffer[at : at + len(value)]
        return len(window) == len(value) and all(w & m == v for w, m, v in zip(window, mask, value))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = None
        if self.state.exists():
            base, buffer, locked, misses, bit = self.state.get()
            held = (base, bytes(buffer), locked, misses, bit)
        for batch in self.input.read(rows):
            if held is None:
                held = (int(batch["offset"].iloc[0]), b"", False, 0, 0)
            for chunk in batch.itertuples(index=False):
                held, out = self._advance(held, bytes(chunk.bytes), chunk.received)
                made = pd.DataFrame(out, columns=["start", "bit", "found", "received", "frame"])
                for name, value in zip(reversed(self.keys), reversed(key)):
                    made.insert(0, name, value)
                yield made
        if held is not None:
            self.state.update(held)

    def _advance(self, held: tuple, octets: bytes, received) -> tuple[tuple, list[tuple]]:
        """State and frames after one more chunk."""
        base, buffer, locked, misses, bit = held
        buffer += octets
        out: list[tuple] = []
        stride, at = len(self.marker) + self.length, 0
        while True:
            if not locked:
                found = first_marker(buffer, at, self.marker, self.bits)
                if found is None:
                    keep = len(self.marker) - (0 if len(self.bits) > 1 else 1)
                    at = max(at, len(buffer) - keep)
                    break
                at, bit, locked, misses = found // 8, found % 8, True, 0
            size = stride + (1 if bit else 0)
            if len(buffer) - at < size:
                break
            seen = self._at(buffer, at, bit)
            misses = 0 if seen else misses + 1
            if misses > FLYWHEEL:
                locked, misses, bit = False, 0, 0
                continue
            begin = at + len(self.marker)
            out.append((base + begin, bit, seen, received, aligned(buffer[begin : at + size], bit)))
            at += stride
        return (base + at, buffer[at:], locked, misses, bit), out

    def close(self) -> None:
        pass


def synchronise(
    chunks: DataFrame,
    frame_length: int,
    keys: Sequence[str] = ("capture_id", "epoch"),
    *,
    marker: bytes = MARKER,
    bit_slip: bool = False,
    most: int = MOST_CHUNKS,
) -> DataFrame:
    """Byte-aligned frames as chunks arrive.

    A task holds at most ``most`` chunks of a recording at once, whatever a micro-batch brings.
    """
    if frame_length < 1:
        raise ValueError("frame_length must be at least 1")
    key_schema = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in keys)
    return chunks.select(*keys, "chunk_no", "offset", "received", "bytes").groupBy(
        *keys
    ).transformWithStateInPandas(
        statefulProcessor=Synchroniser(keys, frame_length, marker, bit_slip, most),
        outputStructType=f"{key_schema}, {OUTPUT}",
        outputMode="Append",
        timeMode="None",
    )
