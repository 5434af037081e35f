"""A frame taken at a wrong place whose checksum holds by chance is a frame, for queries and their SQL."""

import os

import check
import pytest

import __spark_entry__ as entry
from passband.plans.decoding import MODE, RAW
from passband.plans.framing import CHANCE_SQL, STREAM_SQL, wire_oracle

FOLDER = "/root/testdata/sf0.001"
HEX = f"format('{{:04X}}{{:04X}}0004{{:02X}}{{:08X}}', apid + 2048, seq_count + 49152, {MODE}, {RAW})"


def crc(octets, value=0xFFFF):
    for b in octets:
        x = (value >> 8) ^ b
        x ^= x >> 4
        value = (value << 8 ^ x << 12 ^ x << 5 ^ x) & 0xFFFF
    return value


def chosen(con):
    """A packet within a frame taken too early, and the value by which the checksum of that holds."""
    early = con.execute(wire_oracle("SELECT capture_id, w FROM early", **STREAM_SQL, **CHANCE_SQL)).fetchall()
    packets = con.execute(wire_oracle(f"SELECT pkt_no, apid % 4, {HEX} FROM tlm_packet_lossy")).fetchall()
    for capture, digits in early:
        octets = bytes.fromhex(digits)
        # version, secondary header and pointer must let it pass; what is changed lies behind all of them
        if octets[0] >= 64 or octets[4] >= 128 or not (octets[4] & 64 or (octets[4] & 7) * 256 + octets[5] < 50):
            continue
        for number, own, packet in packets:
            at = octets.find(bytes.fromhex(packet), 23)
            if own != capture or not 0 <= at <= 45:
                continue
            head, tail, sent = crc(octets[: at + 9]), octets[at + 11 : 56], int.from_bytes(octets[56:], "big")
            for raw in range(1 << 16):
                if crc(tail, crc(raw.to_bytes(2, "big"), head)) == sent:
                    return number, raw / 100
    return None


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    place = tmp_path_factory.mktemp("chance")
    for name in os.listdir(FOLDER):
        if name != "events.parquet":
            os.symlink(f"{FOLDER}/{name}", place / name)
    # ten more rounds of the events give more frames to choose from
    more = f"SELECT * REPLACE (event_id + 1000 * i AS event_id) FROM '{FOLDER}/events.parquet' CROSS JOIN range(10) r(i)"
    con = check.connect(FOLDER)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * EXCLUDE (i) FROM ({more})")
    number, value = chosen(con)
    con.sql(f"SELECT * REPLACE (CASE WHEN event_id = {number} THEN CAST({value} AS DOUBLE) ELSE value END AS value) FROM events ORDER BY event_id").write_parquet(str(place / "events.parquet"))
    return str(place)


@pytest.mark.parametrize("name", ["frame_cut", "stream_sync"])
def test_query(spark, folder, name):
    con = check.connect(folder)
    assert con.execute(wire_oracle("SELECT count(*) FROM chance", **STREAM_SQL, **CHANCE_SQL)).fetchone()[0] >= 1
    problem = check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert problem is None, problem
