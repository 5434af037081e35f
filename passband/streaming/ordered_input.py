"""Rows of one key in order, in bounded memory, however many a micro-batch brings.

A stateful processor gets the rows of a key as an iterator of frames in no particular order.  Here
they are sorted outside memory: whatever exceeds the buffer goes as sorted runs into keyed state, in
chunks, and the runs are merged chunk by chunk.  At most ``FAN`` runs are merged at once, into longer
ones if there are more.  Nothing is left in state at the end of a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessorHandle

#: Runs merged at once, and chunks of a full buffer.
FAN = 16


def _octets(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _rows(octets: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(pa.BufferReader(octets)) as source:
        return source.read_pandas()


class OrderedInput:
    """Sorts by ``order``; ``most`` rows are held before they are written out.

    What is held at any time is the buffer, or one chunk of ``most / FAN`` rows per merged run.
    """

    def __init__(self, handle: StatefulProcessorHandle, order: str, most: int) -> None:
        self.order, self.most, self.chunk = order, most, max(1, most // FAN)
        self.state = handle.getMapState("waiting", "run bigint, chunk bigint", "rows binary")
        self.runs = 0
        self.peak = 0

    def read(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames that follow each other in order; rows of equal ordinals stand together."""
        held: list[pd.DataFrame] = []
        runs: list[list[tuple]] = []
        self.runs = count = 0
        for batch in batches:
            for at in range(0, len(batch), self.most):
                part = batch.iloc[at : at + self.most]
                if held and count + len(part) > self.most:
                    runs.append(self._write(iter([self._sorted(held)])))
                    held, count = [], 0
                held.append(part)
                count += len(part)
                self.peak = max(self.peak, count)
        if not runs:
            if held:
                yield self._sorted(held)
            return
        if held:
            runs.append(self._write(iter([self._sorted(held)])))
            held = []
        while len(runs) > FAN:
            runs = [self._write(self._merge(runs[i : i + FAN])) for i in range(0, len(runs), FAN)]
        yield from self._merge(runs)

    def _sorted(self, held: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(held, ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)

    def _write(self, frames: Iterator[pd.DataFrame]) -> list[tuple]:
        """(first ordinal, run, chunk) of a run written from frames that follow each other."""
        run, self.runs = self.runs, self.runs + 1
        chunks: list[tuple] = []
        rest: pd.DataFrame | None = None

        def save(rows: pd.DataFrame) -> None:
            self.state.updateValue((run, len(chunks)), (_octets(rows),))
            chunks.append((rows[self.order].iloc[0], run, len(chunks)))

        for rows in frames:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            whole = len(rows) - len(rows) % self.chunk
            for at in range(0, whole, self.chunk):
                save(rows.iloc[at : at + self.chunk])
            rest = rows.iloc[whole:] if whole < len(rows) else None
        if rest is not None:
            save(rest)
        return chunks

    def _merge(self, runs: list[list[tuple]]) -> Iterator[pd.DataFrame]:
        chunks = sorted(c for run in runs for c in run)
        pool: pd.DataFrame | None = None
        for i, (_, run, chunk) in enumerate(chunks):
            rows = _rows(self.state.getValue((run, chunk))[0])
            self.state.removeKey((run, chunk))
            pool = rows if pool is None else self._sorted([pool, rows])
            self.peak = max(self.peak, len(pool))
            if i + 1 == len(chunks):
                yield pool
                return
            # every row still to come is at or behind the first one of the next chunk
            ready = int(pool[self.order].searchsorted(chunks[i + 1][0]))
            if ready:
                yield pool.iloc[:ready]
                pool = pool.iloc[ready:]
