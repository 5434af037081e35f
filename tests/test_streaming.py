"""Stateful processors: rows in order within a fixed buffer, and the same results as in batch."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from passband.fixtures import views, wire
from passband.operators import frames as tm
from passband.operators import gaps as batch_gaps
from passband.operators import packets
from passband.plans import live
from passband.plans.framing import FRAME, LAYOUT
from passband.streaming import assembly, gaps, sync
from passband.streaming.ordered_input import FAN, OrderedInput

FOLDER = "/root/testdata/sf0.001"


class Handle:
    """State of one key, kept in a dictionary."""

    class Map(dict):
        def updateValue(self, key, value):
            self[key] = value

        def getValue(self, key):
            return self[key]

        def removeKey(self, key):
            del self[key]

    def getMapState(self, *_):
        self.map = self.Map()
        return self.map


@pytest.mark.parametrize("rows,size", [(0, 7), (5, 7), (1000, 1000), (40_000, 10_000), (20_000, 333)])
@pytest.mark.parametrize("arrival", ["in order", "shuffled", "interleaved"])
def test_ordered_input_stays_within_its_buffer(rows, size, arrival):
    most = 1024
    numbers = np.arange(rows)
    if arrival == "shuffled":
        numbers = np.random.default_rng(1).permutation(numbers)
    elif arrival == "interleaved":
        numbers = np.concatenate([numbers[k::5] for k in range(5)])
    batches = (pd.DataFrame({"n": numbers[i : i + size], "b": [b"x"] * len(numbers[i : i + size])}) for i in range(0, rows, size))
    handle = Handle()
    source = OrderedInput(handle, "n", most)
    seen, largest = [], 0
    for frame in source.read(batches):
        seen.append(frame["n"].to_numpy())
        largest = max(largest, len(frame))
    assert np.array_equal(np.concatenate([*seen, np.empty(0, int)]), np.arange(rows))
    assert max(source.peak, largest) <= most + 2 * most // FAN
    assert not handle.map


def test_equal_ordinals_all_come():
    rows = pd.DataFrame({"n": [3, 1, 1, 2, 1] * 500})
    got = list(OrderedInput(Handle(), "n", 64).read(rows.iloc[i : i + 10] for i in range(0, 2500, 10)))
    assert pd.concat(got)["n"].tolist() == sorted(rows["n"])


def crowded(spark):
    """One APID with a third of all packets."""
    rows = views.lossy_packets(spark, FOLDER).select("epoch", "apid", "pkt_no", "seq_count")
    return rows.withColumn("apid", F.when(F.col("pkt_no") % 3 == 0, 7).otherwise(F.col("apid")))


def test_dropouts_of_a_crowded_key(spark):
    rows = crowded(spark)
    place, source = live._stream_of(spark, rows, "pkt_no")
    got = live.drain(gaps.dropouts(source, healthy_run=9, summary_interval=4, most=16), place)
    want = batch_gaps.dropout_sessions(rows, healthy_run=9, summary_interval=4)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(got.columns).collect()), key=repr)


def test_assembly_with_a_small_buffer(spark):
    parsed = tm.parse(wire.frames(spark, FOLDER), LAYOUT).filter("status = 'ok'")
    needed = parsed.select("capture_id", "epoch", "vcid", "frame_no", "received", "vc_count", "sync_flag", "fhp", "data")
    place, source = live._stream_of(spark, needed, "frame_no")
    made = live.drain(assembly.assemble(source, most=4), place)
    got = made.filter("pkt_index >= 0").select("capture_id", "vcid", "frame_no", "bytes")
    want = packets.segment_packets(packets.segments(needed)).select(got.columns)
    assert got.count() > 100
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_sync_with_a_small_buffer(spark):
    place, source = live._stream_of(spark, wire.recording(spark, FOLDER), "chunk_no")
    few = live.drain(sync.synchronise(source, FRAME, most=2), place)
    place, source = live._stream_of(spark, wire.recording(spark, FOLDER), "chunk_no")
    many = live.drain(sync.synchronise(source, FRAME), place)
    assert many.count() > 50
    assert few.exceptAll(many).count() == many.exceptAll(few).count() == 0


def test_octets_between_octets():
    rng = np.random.default_rng(2)
    for bit in range(1, 8):
        octets = rng.bytes(40)
        number = int.from_bytes(octets, "big") << bit >> 8 & ((1 << 312) - 1)
        assert sync.aligned(octets, bit) == number.to_bytes(39, "big")
    assert sync.aligned(b"abc", 0) == b"abc"
