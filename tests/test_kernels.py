"""Published check values and identities of the octet kernels."""

import random
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from passband.functions import bits, checksum, predicates, text
from passband.functions import timecode as tc
from passband.operators import coding, csp, frames


def test_checksum_check_values():
    octets = pd.Series([b"123456789", b"", b"12"])
    assert checksum.crc16_of(octets)[0] == 0x29B1
    assert checksum.crc32c_of(octets)[0] == 0xE3069283
    assert checksum.crc16_of(octets)[1] == 0xFFFF


def test_randomiser_prefix_and_period():
    assert coding.randomiser()[:5].tobytes().hex() == "ff480ec09a"
    data = bytes(range(256)) * 3
    once = coding.derandomise_of(pd.Series([data]))[0]
    assert coding.derandomise_of(pd.Series([once]))[0] == data
    assert once[255:260] == bytes(a ^ b for a, b in zip(data[255:260], coding.randomiser()[:5].tobytes()))


@pytest.mark.parametrize("parity", [32, 16])
def test_randomiser_is_a_codeword_and_flips_are_seen(parity):
    """Screening without derandomising is clean, and wrong: the order of stages matters."""
    word = coding.randomiser()
    flipped = np.tile(word, (6, 1))
    for row, count in enumerate((0, 1, 2, 5, 16, 17)):
        flipped[row, :count] ^= 0x5A
    weights = coding.syndrome_weights(flipped, parity)
    assert weights[0] == 0 and (weights[1:] > 0).all()
    assert coding.syndrome_weights(np.zeros((1, 255), np.uint8), parity)[0] == 0
    assert coding.syndrome_weights(np.roll(word, 7)[None, :], parity)[0] == 0


def test_screen_interleaves_and_refuses_odd_sizes(spark):
    word = coding.randomiser()
    block = np.repeat(word, 2).tobytes()
    bad = bytearray(block)
    bad[3] ^= 1
    rows = [(0, bytearray(block)), (1, bad), (2, bytearray(block[:-1]))]
    df = spark.createDataFrame(rows, "n int, block binary")
    got = {r.n: (r.syndromes, r.dirty) for r in coding.screened(df, interleave=2).collect()}
    assert got[0] == (0, False) and got[1][1] and got[2] == (None, True)
    with pytest.raises(ValueError):
        coding.screen(32, 6)


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


def test_bit_fields(spark):
    b = F.col("b")
    got = one(
        spark,
        "b binary",
        (bytearray.fromhex("080bca2e0040c0091eb851eb851f42280000ffc00000"),),
        bits.unsigned(b, 5, 11), bits.unsigned(b, 18, 14), bits.unsigned(b, 32, 16),
        bits.ieee754(b, 48, 64), bits.ieee754(b, 112, 32), bits.ieee754(b, 144, 32),
        bits.unsigned(b, 48, 64), bits.signed(b, 48, 16), bits.unsigned(b, 170, 16),
    )
    assert got[:3] == (11, 2606, 64)
    assert got[3] == -3.14 and got[4] == 42.0 and np.isnan(got[5])
    assert int(got[6]) == 0xC0091EB851EB851F and got[7] == 0xC009 - 65536 and got[8] is None


def test_time_codes(spark):
    b = F.col("b")
    got = one(
        spark,
        "b binary",
        (bytearray.fromhex("0000000180000000"),),
        tc.cuc_from_bytes(b, 4, 2, "unix"), tc.cuc_from_bytes(b, 4, 4, 0), tc.cuc_from_bytes(b, 4, 5, 0),
        tc.cuc_from_bytes(b, 4, 0), tc.cuc_from_unsigned(F.lit(0x18000), 2, 2, 0),
        tc.cds_from_bytes(b, 2, 0, 0), tc.cds_from_bytes(b, 2, 2, 0), tc.cds_from_bytes(b, 3, 2, 0),
        tc.from_seconds(F.lit(1.5), "gps"), tc.from_seconds(F.lit(float("nan"))), tc.from_seconds(F.lit(1e12)),
        tc.from_seconds(F.lit(-0.25)), tc.cuc_from_bytes(F.unhex(F.lit("ff" * 8)), 8, 0, 0),
    )
    assert got == (
        1_500_000_000, 1_500_000_000, None, -378_691_199 * 10**9, 1_500_000_000,
        98_304 * 10**6, 98_304 * 10**6, None,
        315_964_801_500_000_000, None, None, -250_000_000, None,
    )


def test_leap_second_of_day(spark):
    def cds(millis):
        return F.unhex(F.lit("0000" + f"{millis:08x}"))

    got = one(spark, "x int", (1,), tc.cds_from_bytes(cds(86_400_999), 2, 0, 0), tc.cds_from_bytes(cds(86_401_000), 2, 0, 0))
    assert got == (86_400_999 * 10**6, None)


def test_text_forms(spark):
    n = F.col("n")
    rows = [(1_704_067_207_179_999_999,), (-1,), (0,)]
    df = spark.createDataFrame(rows, "n bigint")
    assert [r[0] for r in df.select(text.iso(n)).collect()] == [
        "2024-01-01T00:00:07.179Z", "1969-12-31T23:59:59.999Z", "1970-01-01T00:00:00.000Z",
    ]
    ages = spark.createDataFrame([(1.25,), (59.9,), (600.0,), (-7200.0,), (None,), (864000.0,)], "s double")
    assert [r[0] for r in ages.select(text.age(F.col("s"))).collect()] == ["1.2 s", "60 s", "10 m", "-2.0 h", "never", "10 d"]
    floats = spark.createDataFrame([(1.0,), (0.5,), (1e21,), (1e-5,), (float("nan"),), (-0.1,)], "f double")
    assert [r[0] for r in floats.select(text.float_text(F.col("f"))).collect()] == [
        "1", "0.5", "1000000000000000000000", "0.00001", "NaN", "-0.1",
    ]
    octets = spark.createDataFrame([(bytearray(range(9)),), (bytearray(b"\xab"),)], "b binary")
    assert [r[0] for r in octets.select(text.hex_preview(F.col("b"))).collect()] == ["0001020304050607… (9 bytes)", "ab"]


def test_text_of_exact_values(spark):
    rng = random.Random(3)
    values = [1.15, 0.95, 0.25, 0.35, 9.95, 9.949999999999999, -0.04, -1.15, 12.5, 13.5, 0.0]
    values += [rng.randrange(2000) / 200 for _ in range(300)] + [rng.uniform(-60, 60) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    want = [f"{v:.1f} s" if abs(v) < 10 else f"{v:.0f} s" for v in values]
    got = [r[0] for r in df.select(text.age(F.col("s"))).collect()]
    assert [g for g, w, v in zip(got, want, values) if g != w] == []
    values = [1e-40, 1.2345678901234567e-25, 1e40, -1.25e22, 5e-324, 1.7976931348623157e308, 123456789012345680.0, 0.001, 1e7, 1.5e7]
    df = spark.createDataFrame([(v,) for v in values], "f double")
    got = [r[0] for r in df.select(text.float_text(F.col("f"))).collect()]
    for g, v in zip(got, values):
        assert float(g) == v and "E" not in g and not g.endswith(".0"), (g, v)
    assert got[0] == "0." + "0" * 39 + "1" and got[2] == "1" + "0" * 40


def test_limits_and_nan(spark):
    rows = [(5.0, 0), (60.0, 1), (80.0, 2), (95.0, 3), (float("nan"), 0), (None, 0)]
    df = spark.createDataFrame([(v, s) for v, s in rows[1:]], "v double, s int")
    state = predicates.limit_state(F.col("v"), F.lit(20.0), F.lit(60.0), F.lit(12.5), F.lit(90.0))
    assert all(r.s == r.got for r in df.withColumn("got", state).collect())
    only_alarm = predicates.limit_state(F.lit(5.0), F.lit(None), F.lit(None), F.lit(6.0), F.lit(None))
    assert one(spark, "x int", (1,), only_alarm)[0] == 3


def test_same_value_is_per_kind(spark):
    def v(kind, **fields):
        return predicates.value_struct(kind, **{k: F.lit(x) for k, x in fields.items()})

    got = one(
        spark, "x int", (1,),
        predicates.same_value(v("Unsigned", i=1), v("Unsigned", i=1)),
        predicates.same_value(v("Unsigned", i=1), v("Signed", i=1)),
        predicates.same_value(v("Float", f=float("nan")), v("Float", f=float("nan"))),
        predicates.same_value(v("Label", s="A"), v("Text", s="A")),
    )
    assert got == (True, False, False, False)


def test_ascii_fold_only(spark):
    df = spark.createDataFrame([("/Sat/TEMP",), ("/Sat/ÄRGER",)], "n string")
    assert [r[0] for r in df.select(predicates.contains_ascii_fold(F.col("n"), "temp")).collect()] == [True, False]
    assert [r[0] for r in df.select(predicates.contains_ascii_fold(F.col("n"), "ärger")).collect()] == [False, False]


def test_csp_versions_and_refusals(spark):
    def crc(b):
        return int(checksum.crc32c_of(pd.Series([b]))[0]).to_bytes(4, "big")

    v1 = ((1 << 30) | (3 << 25) | (4 << 20) | (7 << 14) | (9 << 8) | 1).to_bytes(4, "big")
    v2 = ((2 << 46) | (300 << 32) | (5 << 18) | (6 << 12) | (8 << 6)).to_bytes(6, "big")
    rows = {
        "whole": v1 + b"hello" + crc(v1 + b"hello"),
        "bare": v1 + b"hello" + crc(b"hello"),
        "wrong": v1 + b"hello" + b"\0\0\0\0",
        "short": v1[:3],
        "no room": v1 + b"abc",
        "xtea": v1[:3] + b"\x04" + b"hi",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows.items()], "k string, bytes binary")
    got = {r.k: r for r in csp.parse(df, 1).collect()}
    assert {k: r.status for k, r in got.items()} == {
        "whole": "ok", "bare": "ok", "wrong": "bad_checksum", "short": "too_short", "no room": "too_short", "xtea": "encryption",
    }
    assert bytes(got["bare"].payload) == b"hello"
    assert (got["whole"].source, got["whole"].destination, got["whole"].destination_port, got["whole"].source_port) == (3, 4, 7, 9)
    two = csp.parse(spark.createDataFrame([(bytearray(v2 + b"x"),)], "bytes binary"), 2).first()
    assert (two.status, two.destination, two.source, bytes(two.payload)) == ("ok", 300, 5, b"x")


def test_frame_optional_fields(spark):
    layout = frames.FrameLayout(has_fecf=True, has_ocf=True, insert_zone=2)
    body = bytes.fromhex("02a3010280001122" + "02aabb" + "010203040506" + "cafebabe")
    whole = body + int(checksum.crc16_of(pd.Series([body]))[0]).to_bytes(2, "big")
    row = frames.parse(spark.createDataFrame([(bytearray(whole),)], "frame binary"), layout).first()
    assert row.status == "ok" and row.ocf_flag == 1 and row.scid == 42 and row.vcid == 1
    assert bytes(row.insert_zone).hex() == "1122" and bytes(row.secondary_header).hex() == "02aabb"
    assert bytes(row.data).hex() == "010203040506" and bytes(row.ocf).hex() == "cafebabe"
