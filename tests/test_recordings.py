"""Recordings as files: scan, fixed records, replay laps, message stream, sink."""

import tempfile
from pathlib import Path

import pytest

from passband.operators import packets
from passband.sources import recording


@pytest.fixture()
def place():
    return Path(tempfile.mkdtemp(prefix="passband-test-", dir="/tmp"))


def test_file_scan_keeps_every_octet(spark, place):
    data = bytes(range(256)) * 5 + b"tail"
    (place / "pass.bin").write_bytes(data)
    (place / "empty.bin").write_bytes(b"")
    rows = sorted(recording.scan(spark, str(place), 100).collect(), key=lambda r: r.chunk_no)
    assert b"".join(bytes(r.bytes) for r in rows) == data
    assert [r.offset for r in rows] == [100 * i for i in range(13)] and len(rows[-1].bytes) == 84


def test_one_file_by_many_ranges(spark, place):
    """A file is cut at multiples of the unit; tasks read their ranges alone."""
    data = bytes(i * 7 % 251 for i in range(10_007))
    folder = place / "a pass, März"
    folder.mkdir()
    (folder / "long one.bin").write_bytes(data)
    cut = recording.ranges(spark, str(folder), 100, 1000)
    assert cut.count() == 11 and "content" not in cut._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    rows = sorted(recording.scan(spark, str(folder), 100, range_octets=1000).collect(), key=lambda r: r.chunk_no)
    assert b"".join(bytes(r.bytes) for r in rows) == data and [r.chunk_no for r in rows] == list(range(101))
    records = recording.fixed_records(spark, str(folder), 64, range_octets=100).orderBy("frame_no").collect()
    assert [bytes(r.frame) for r in records] == [data[i : i + 64] for i in range(0, 64 * 156, 64)]
    with pytest.raises(ValueError):
        recording.scan(spark, str(folder), 0)


def test_fixed_records(spark, place):
    (place / "frames.bin").write_bytes(b"".join(bytes([i]) * 10 for i in range(7)))
    rows = recording.fixed_records(spark, str(place / "frames.bin"), 10).orderBy("frame_no").collect()
    assert [(r.frame_no, bytes(r.frame)) for r in rows] == [(i, bytes([i]) * 10) for i in range(7)]


def test_replay_laps_are_epochs_and_the_sink_appends(spark, place):
    (place / "pass.bin").write_bytes(b"x" * 250)
    chunks = recording.scan(spark, str(place / "pass.bin"), 100).selectExpr(
        "1L as capture_id", "epoch", "chunk_no", "offset", "received", "bytes"
    )
    recording.append(chunks, str(place / "store"))
    stream = recording.replay(spark, str(place / "store"), octets_per_trigger=1 << 20, laps=2)
    query = recording.record(stream, str(place / "copy"), str(place / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    copied = spark.read.parquet(str(place / "copy"))
    assert sorted((r.epoch, r.chunk_no, len(r.bytes)) for r in copied.collect()) == [
        (e, n, size) for e in (0, 1) for n, size in ((0, 100), (1, 100), (2, 50))
    ]


def test_message_stream_needs_no_state(spark, place):
    whole = bytearray(bytes.fromhex("0801c0000000aa") * 2)
    spark.createDataFrame([(1, whole), (2, whole[:-1])], "msg_id bigint, bytes binary").selectExpr(
        "msg_id", "timestamp_seconds(msg_id) as received", "bytes"
    ).write.parquet(str(place / "in"))
    split = packets.walked(recording.messages(spark, str(place / "in")))
    query = (
        packets.message_packets(split, ["msg_id"]).writeStream.format("parquet").option("path", str(place / "out"))
        .option("checkpointLocation", str(place / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(str(place / "out")).groupBy("msg_id").count().collect()
    assert {r.msg_id: r["count"] for r in rows} == {1: 2, 2: 1}
