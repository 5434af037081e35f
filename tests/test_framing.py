"""Framing jobs against plain sequential rules, for several chunk and slice sizes."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from passband.operators import chunks, markers, packets, stream_split
from passband.plans import framing

MARKER, LENGTH = markers.MARKER, 20
CHUNK = "capture_id bigint, epoch int, chunk_no bigint, offset bigint, received timestamp, bytes binary"


def chunked(capture, data, size):
    when = dt.datetime(2024, 1, 1)
    return [
        (capture, 0, n, at, when + dt.timedelta(seconds=n), bytearray(data[at : at + size]))
        for n, at in enumerate(range(0, len(data), size))
    ]


def marker_at(data, at, bit):
    value, mask = markers.shifted(MARKER, bit)
    window = data[at : at + len(value)]
    return len(window) == len(value) and all(w & m == v for w, m, v in zip(window, mask, value))


def lock_walk(data, slip):
    """Search, lock, and up to four missing markers in a row, octet by octet."""
    out, at, locked, bit, misses, stride = [], 0, False, 0, 0, 4 + LENGTH
    while True:
        if not locked:
            places = ((i, b) for i in range(at, len(data) - 3) for b in range(8 if slip else 1))
            hit = next((p for p in places if marker_at(data, *p)), None)
            if hit is None:
                return out
            (at, bit), locked, misses = hit, True, 0
        size = stride + (1 if bit else 0)
        if len(data) - at < size:
            return out
        seen = marker_at(data, at, bit)
        misses = 0 if seen else misses + 1
        if misses > 4:
            locked, misses, bit = False, 0, 0
            continue
        frame = data[at + 4 : at + size]
        if bit:
            frame = ((int.from_bytes(frame, "big") << bit >> 8) & ((1 << 8 * LENGTH) - 1)).to_bytes(LENGTH, "big")
        out.append((at + 4, seen, frame))
        at += stride


def noisy_stream(rng, slips):
    data = b""
    for _ in range(10):
        part = b""
        for _ in range(rng.randint(1, 14)):
            body = bytearray(rng.randbytes(LENGTH))
            if rng.random() < 0.15:
                body[3:7] = MARKER
            part += (MARKER if rng.random() < 0.6 else bytes(4)) + bytes(body)
        slip = rng.choice(slips)
        if slip:
            part = (int.from_bytes(part, "big") << (8 - slip)).to_bytes(len(part) + 1, "big")
        data += part + rng.randbytes(rng.randint(0, 9))
        if rng.random() < 0.2:
            data += bytes(rng.randint(0, 400))
    return data


@pytest.mark.parametrize("slip", [False, True])
def test_frame_cut(spark, slip):
    rng = random.Random(5)
    streams = {c: noisy_stream(rng, [0, 0, 3, 5] if slip else [0]) for c in range(5)}
    rows = [r for c, d in streams.items() for r in chunked(c, d, [7, 50, 256, 33, 5][c])]
    recorded = spark.createDataFrame(rows, CHUNK)
    totals = recorded.groupBy("capture_id", "epoch").agg(F.max(F.col("offset") + F.length("bytes")).alias("total"))
    cells = chunks.recut(recorded.withColumnRenamed("bytes", "octets"), markers.KEYS, 64)
    for size in (260, 1 << 26):
        starts = markers.frame_starts(markers.scan(recorded, bit_slip=slip), totals, LENGTH, slice_octets=size)
        got = {c: [] for c in streams}
        for r in markers.cut_frames(cells, starts, LENGTH, 64).collect():
            got[r.capture_id].append((r.frame_no, r.found, bytes(r.frame)))
        for c, data in streams.items():
            assert sorted(got[c]) == sorted(lock_walk(data, slip)), (c, size)


def test_first_marker():
    rng = random.Random(12)
    for _ in range(300):
        bits = range(8) if rng.random() < 0.7 else range(1)
        data = bytes(rng.choice(b"\x3c\x70\x78\xe0\x1e\x38") for _ in range(rng.randint(0, 40)))
        start = rng.randint(0, 10)
        want = [p for p in markers.find_marker(data, b"<p", bits) if p // 8 >= start]
        assert markers.first_marker(data, start, b"<p", bits) == (want[0] if want else None)


def test_marker_scan_is_chunk_size_invariant(spark):
    rng = random.Random(8)
    data = b"".join(rng.randbytes(rng.randint(0, 30)) + MARKER for _ in range(40))
    want = [i for i in range(len(data)) if data[i : i + 4] == MARKER]
    for size in (1, 2, 3, 7, 65_536):
        df = spark.createDataFrame(chunked(0, data, size), CHUNK)
        assert sorted(r.pos for r in markers.scan(df).collect()) == want, size
    histogram = {r.stride: r.intervals for r in markers.strides(markers.scan(df), width=64).collect()}
    steps = [b - a for a, b in zip(want, want[1:])]
    assert histogram == {s: steps.count(s) for s in set(steps)}


def test_advice(spark):
    df = spark.createDataFrame([(1279, 9, 10), (1119, 3, 10), (4, 1, 1), (1534, 1, 1)], "stride bigint, intervals bigint, total bigint")
    got = {r.stride: r for r in markers.advice(df).collect()}
    assert (got[1279].kind, got[1279].interleave, got[1279].frame_length, got[1279].consistent) == ("coded", 5, 1115, True)
    assert (got[1119].kind, got[1119].frame_length, got[1119].consistent) == ("uncoded", 1115, False)
    assert got[4].kind == "not_frames" and got[1534].kind == "uncoded"


def split_rule(pieces, limit):
    """One pass over chunks as they come; a desync drops everything received so far."""
    held, base, out, left = b"", 0, [], []
    for data, when in pieces:
        held, at, lost_step = held + data, 0, False
        while len(held) - at >= 6:
            size = 7 + (held[at + 4] << 8 | held[at + 5])
            if size > limit:
                lost_step = True
                break
            if size > len(held) - at:
                break
            out.append((base + at, when, held[at : at + size]))
            at += size
        if lost_step:
            left.append((base + at, 0, len(held) - at, "desync"))
            base, held = base + len(held), b""
        else:
            base, held = base + at, held[at:]
    if held:
        left.append((base, 1, len(held), "cut_off"))
    return out, left


@pytest.mark.parametrize("limit", [65_542, 3000])
def test_stream_split(spark, limit):
    rng = random.Random(7)
    rows, want, when = [], {}, dt.datetime(2024, 1, 1)
    for capture, total in enumerate([200_000, 70_005, 40, 150_000]):
        data = b""
        while len(data) < total:
            size = rng.choice([7, 20, 300, 2000, 60_000 if capture == 3 else 900])
            data += rng.randbytes(4) + (size - 7).to_bytes(2, "big") + rng.randbytes(size - 6)
        data, at, pieces = data[:total], 0, []
        while at < total:
            part = data[at : at + rng.randint(1, 9000)]
            stamp = when + dt.timedelta(seconds=len(pieces))
            rows.append((capture, 0, len(pieces), at, stamp, bytearray(part)))
            pieces.append((part, stamp))
            at += len(part)
        want[capture] = split_rule(pieces, limit)
    recorded = spark.createDataFrame(rows, CHUNK)
    whole, left = stream_split.split(recorded, max_length=limit, cell=70_000)
    got, rest = {}, {}
    for r in whole.collect():
        got.setdefault(r.capture_id, []).append((r.offset, r.received, bytes(r.bytes)))
    for r in left.collect():
        rest.setdefault(r.capture_id, []).append((r.offset, r.lost, r.discarded, r.reason))
    for capture, (out, lost) in want.items():
        assert sorted(got.get(capture, [])) == sorted(out)
        assert sorted(rest.get(capture, [])) == sorted(lost)


def assembly_rule(frames, limit):
    """Frame by frame over one channel."""
    out, lost, dropped, partial, last = [], 0, 0, b"", None

    def size_of(b):
        return 7 + (b[4] << 8 | b[5]) if len(b) >= 6 else None

    for n, count, sync, fhp, data in frames:
        if last is not None and (count - last - 1) % 256 and partial:
            lost, dropped, partial = lost + 1, dropped + len(partial), b""
        last = count
        if sync or fhp == 0x7FE:
            continue
        head, rest = (data, b"") if fhp == 0x7FF else (data[:fhp], data[fhp:])
        if partial:
            partial += head
            size = size_of(partial)
            if size and size > limit:
                lost, dropped, partial = lost + 1, dropped + len(partial), b""
            elif size and len(partial) >= size:
                out.append((n, partial[:size]))
                dropped, partial = dropped + len(partial) - size, b""
            elif fhp != 0x7FF:
                lost, dropped, partial = lost + 1, dropped + len(partial), b""
        else:
            dropped += len(head)
        while rest:
            size = size_of(rest)
            if size and size > limit:
                dropped, rest = dropped + len(rest), b""
            elif size and size <= len(rest):
                out.append((n, rest[:size]))
                rest = rest[size:]
            else:
                partial, rest = rest, b""
    if partial:
        lost, dropped = lost + 1, dropped + len(partial)
    return out, lost, dropped


@pytest.mark.parametrize("width", [5, 1 << 20])
def test_reassembly(spark, width):
    rng = random.Random(21)
    rows, want, limit = [], {}, 200
    for vcid in range(4):
        stream, starts = b"", []
        while len(stream) < 4000:
            size = rng.choice([7, 30, 90, 190, 210 if vcid == 2 else 12])
            starts.append(len(stream))
            stream += rng.randbytes(4) + (size - 7).to_bytes(2, "big") + rng.randbytes(size - 6)
        frames, count = [], rng.randint(0, 255)
        for k in range(len(stream) // 40):
            low = k * 40
            first = next((s - low for s in starts if low <= s < low + 40), 0x7FF)
            if vcid == 3 and rng.random() < 0.1 and first != 0x7FF:
                first = min(39, first + 1)
            frames.append((count % 256, 0, first, stream[low : low + 40]))
            count += 1
            if rng.random() < 0.1:
                frames.append((count % 256, int(rng.random() < 0.5), 0x7FE, rng.randbytes(40)))
                count += 1
        kept = [(n * 4 + vcid, *f) for n, f in enumerate(frames) if vcid == 0 or rng.random() > 0.06]
        want[vcid] = assembly_rule(kept, limit)
        rows += [(1, 0, n, vcid, c, s, p, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n), bytearray(d)) for n, c, s, p, d in kept]
    df = spark.createDataFrame(
        rows, "capture_id bigint, epoch int, frame_no bigint, vcid int, vc_count int, sync_flag int, fhp int, received timestamp, data binary"
    )
    read = packets.segments(df, max_length=limit, width=width)
    got = {v: [] for v in want}
    for r in packets.segment_packets(read).collect():
        assert r.received == dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.frame_no)
        got[r.vcid].append((r.frame_no, r.pkt_index, bytes(r.bytes)))
    losses = {r.vcid: (r.lost, r.discarded) for r in packets.segment_losses(read).groupBy("vcid").agg(F.sum("lost").alias("lost"), F.sum("discarded").alias("discarded")).collect()}
    for vcid, (out, lost, dropped) in want.items():
        assert sorted((n, b) for n, _, b in got[vcid]) == sorted(out), vcid
        assert losses.get(vcid, (0, 0)) == (lost, dropped), vcid


def test_messages_stand_alone(spark):
    whole = bytes.fromhex("0801c0000000aa") * 3
    rows = [(1, bytearray(whole)), (2, bytearray(whole[:-2])), (3, bytearray(whole + bytes.fromhex("0801c000ffff"))), (4, bytearray(b""))]
    split = packets.walked(spark.createDataFrame(rows, "msg_id bigint, bytes binary"), max_length=100)
    counts = {r.msg_id: r["count"] for r in packets.message_packets(split, ["msg_id"]).groupBy("msg_id").count().collect()}
    assert counts == {1: 3, 2: 2, 3: 3}
    left = {r.msg_id: (r.lost, r.discarded, r.reason) for r in packets.message_residuals(split, ["msg_id"]).collect()}
    assert left == {2: (1, 5, "cut_off"), 3: (0, 6, "desync")}


def test_loss_lines(spark):
    rows = [(1, 0, 3, 40, "frames_missing", 0, 0, 2), (1, 0, 3, 39, "abandoned", 1, 17, 0), (1, 0, 3, None, "leading_fragment", 0, 9, 0)]
    events = spark.createDataFrame(rows, "capture_id int, epoch int, vcid int, frame_no bigint, kind string, lost int, discarded bigint, missing int")
    lines = [(r.seq_no, r.severity, r.message) for r in packets.loss_lines(events).orderBy("seq_no").collect()]
    assert lines == [
        (-1, 1, "virtual channel 3: 9 octets without a packet in front of them"),
        (39, 1, "virtual channel 3: 1 packet lost, 17 octets discarded"),
        (40, 1, "virtual channel 3: 2 frames missing"),
    ]


def test_coding_order_synchronises_once(spark, monkeypatch):
    """Both orders read the blocks of one recording, which is laid out and cut once."""
    calls = []
    for module, name in ((framing.wire, "recording"), (framing.recovery.markers, "scan")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, _real=real, _name=name, **k: calls.append(_name) or _real(*a, **k))
    rows = framing.coding_order(spark, "/root/testdata/sf0.001").collect()
    assert sorted(calls) == ["recording", "scan"]
    assert all(r.clean > 0 and r.ok == (r.clean if r.derandomised else 0) for r in rows)


def test_ways_that_stay_apart_are_followed_all_at_once():
    """Short packets alike: ways into a cell that start between them run side by side for long."""
    rng = random.Random(3)
    packet = lambda: bytes([8, rng.randrange(256), 192 + rng.randrange(3), rng.randrange(256), 0, 4, rng.randrange(5), 0, 0, rng.randrange(100), rng.randrange(256)])
    body = 1 << 20
    octets = b"".join(packet() for _ in range(100_000))[: body + 5]
    ends, began = np.array([body]), time.process_time()
    out = stream_split.ways_out(octets, body, range(65_542), 65_542, ends)
    assert time.process_time() - began < 20  # over a minute where ways are walked packet by packet
    for at in rng.sample(range(65_542), 20):
        entry = at
        while at < body:
            at = stream_split._step(octets, at, 65_542, ends)
        assert out[entry] == at


def test_cells_of_a_recording_are_read_by_tasks_of_their_own(spark):
    """One recording of short packets is several cells, and they are not merged into one task."""
    octets = bytes.fromhex("0801c00000040000000000") * 20_000
    rows = [(0, 0, n, n * 22_000, dt.datetime(2024, 1, 1), bytearray(octets[n * 22_000 : (n + 1) * 22_000])) for n in range(10)]
    whole, _ = stream_split.split(spark.createDataFrame(rows, CHUNK), cell=70_000)
    assert whole.count() == 20_000
    assert whole.select(F.spark_partition_id()).distinct().count() > 1
