"""Sequence gaps and dropouts across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from passband.operators.gaps import GAP_SUMMARY_INTERVAL, HEALTHY_RUN, SEQUENCE_MODULUS
from passband.streaming.ordered_input import OrderedInput

STATE = "last int, arrived bigint, last_gap bigint, gaps bigint, missing bigint"
#: Packets of a key held at once.
MOST_PACKETS = 1 << 17
LINES = "rn bigint, kind string, seq_count int, gaps bigint, missing bigint"


class GapTracker(StatefulProcessor):
    """Per key: the last count, and the dropout that is open.

    A restart of the source is a new epoch in the key, so nothing is ever compared across it.
    Rows of a micro-batch are put in arrival order first and read piece by piece.
    """

    def __init__(self, keys: Sequence[str], healthy_run: int, summary_interval: int, most: int) -> None:
        self.keys, self.healthy, self.every, self.most = list(keys), healthy_run, summary_interval, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tracker", STATE)
        self.input = OrderedInput(handle, "pkt_no", self.most)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else (-1, 0, -1, 0, 0)
        held = tuple(int(x) for x in held)
        for batch in self.input.read(rows):
            held, out = self._advance(held, batch)
            for name, value in zip(reversed(self.keys), reversed(key)):
                out.insert(0, name, value)
            yield out
        self.state.update(held)

    def _advance(self, held: tuple, batch: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        """State and lines after packets that follow the ones before."""
        last, arrived, last_gap, gaps, missing = held
        counts = batch["seq_count"].to_numpy(dtype=np.int64) % SEQUENCE_MODULUS
        before = np.concatenate(([last if last >= 0 else counts[0]], counts[:-1]))
        missed = np.where(counts == before, 0, (counts - before - 1) % SEQUENCE_MODULUS)
        lines: list[tuple] = []

        def close(at: int) -> bool:
            """The dropout ends once enough packets in a row were contiguous."""
            if gaps and at >= last_gap + self.healthy:
                lines.append((last_gap + self.healthy, "recovered", None, gaps, missing))
                return True
            return False

        for i in np.flatnonzero(missed):
            rn = arrived + int(i) + 1
            if close(rn - 1):
                gaps = missing = 0
            gaps, missing, last_gap = gaps + 1, missing + int(missed[i]), rn
            if gaps == 1 or gaps % self.every == 0:
                kind = "first" if gaps == 1 else "running"
                lines.append((rn, kind, int(batch["seq_count"].iloc[i]), gaps, missing))
        arrived += len(counts)
        if close(arrived):
            gaps = missing = 0
        out = pd.DataFrame(lines, columns=["rn", "kind", "seq_count", "gaps", "missing"])
        out["seq_count"] = out["seq_count"].astype("Int32")
        return (int(counts[-1]), arrived, last_gap, gaps, missing), out

    def close(self) -> None:
        pass


def dropouts(
    packets: DataFrame,
    keys: Sequence[str] = ("epoch", "apid"),
    *,
    healthy_run: int = HEALTHY_RUN,
    summary_interval: int = GAP_SUMMARY_INTERVAL,
    most: int = MOST_PACKETS,
) -> DataFrame:
    """The lines of :func:`passband.operators.gaps.dropout_sessions`, as they come about.

    A task holds at most ``most`` packets of a key at once, whatever a micro-batch brings.
    """
    key_schema = ", ".join(f"{k} {packets.schema[k].dataType.simpleString()}" for k in keys)
    return packets.select(*keys, "pkt_no", "seq_count").groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=GapTracker(keys, healthy_run, summary_interval, most),
        outputStructType=f"{key_schema}, {LINES}",
        outputMode="Append",
        timeMode="None",
    )
