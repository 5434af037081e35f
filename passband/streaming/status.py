"""Live tables: latest values, status lines, rates, silence alarms, restart epochs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from passband.operators import store
from passband.operators.link import LIVE_SECONDS, QUIET_SECONDS
from passband.operators.ordered import DEFAULT_WIDTH, carry


def latest_values(samples: DataFrame) -> DataFrame:
    """Latest value and update count per parameter; write in ``update`` mode, once per batch."""
    return store.latest(samples)


def status_lines(packets: DataFrame, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Running counters per stream, for ``update`` mode with a one-second trigger."""
    return packets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets_in"),
        F.sum(F.col("pkt_len").cast("bigint")).alias("bytes_in"),
        F.max("received").alias("last_packet"),
    )


def observed(packets: DataFrame, name: str = "status") -> DataFrame:
    """The same counters as metrics of the query itself, without any state."""
    return packets.observe(
        name, F.count(F.lit(1)).alias("packets_in"), F.max("received").alias("last_packet")
    )


def windowed_rates(
    packets: DataFrame, keys: Sequence[str] = (), *, delay: str = "10 seconds"
) -> DataFrame:
    """Rates over sliding five-second windows of receipt time, every half second."""
    stamped = packets.withWatermark("received", delay)
    return stamped.groupBy(*keys, F.window("received", "5 seconds", "500 milliseconds")).agg(
        (F.sum(F.col("pkt_len").cast("bigint")) / F.lit(5.0)).alias("bytes_per_second"),
        (F.count(F.lit(1)) / F.lit(5.0)).alias("packets_per_second"),
    )


def with_epochs(
    rows: DataFrame, keys: Sequence[str], order: str, restart: str = "restart", *, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Number the stretches between restart markers, which keep their place in arrival order."""
    marks = F.when(F.col(restart), 1).otherwise(0)
    return carry(rows, keys, order, sums={"epoch": marks}, width=width)


class SilenceAlarm(StatefulProcessor):
    """Per stream: live on every arrival, quiet and stopped by timers when nothing arrives."""

    def __init__(self, keys: Sequence[str], live: float, quiet: float) -> None:
        self.keys, self.live_ms, self.quiet_ms = list(keys), int(live * 1000), int(quiet * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")

    def _line(self, key, state: str, at: int) -> pd.DataFrame:
        row = dict(zip(self.keys, key)) | {"state": state, "at_ms": at}
        return pd.DataFrame([row])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:
            pass
        now = timerValues.getCurrentProcessingTimeInMs()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((now,))
        self.handle.registerTimer(now + self.live_ms + 1)
        self.handle.registerTimer(now + self.quiet_ms + 1)
        yield self._line(key, "live", now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        silent = at - self.last.get()[0]
        yield self._line(key, "stopped" if silent > self.quiet_ms else "quiet", at)

    def close(self) -> None:
        pass


def silence(
    packets: DataFrame,
    keys: Sequence[str] = ("capture_id",),
    *,
    live: float = LIVE_SECONDS,
    quiet: float = QUIET_SECONDS,
) -> DataFrame:
    """Changes of liveness of every stream, also while no data comes.

    A stream is live with every arrival, quiet after ``live`` seconds without one, and stopped
    after ``quiet`` seconds.  The processing clock decides, so the query has to keep running.
    """
    key_schema = ", ".join(f"{k} {packets.schema[k].dataType.simpleString()}" for k in keys)
    return packets.select(*keys).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=SilenceAlarm(keys, live, quiet),
        outputStructType=f"{key_schema}, state string, at_ms bigint",
        outputMode="Update",
        timeMode="ProcessingTime",
    )
