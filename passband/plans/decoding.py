"""Decoding: headers, containers, calibration, time codes, refusals, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passband.fixtures import mission, views
from passband.fixtures.views import micros, oracle
from passband.functions import timecode
from passband.functions.bits import big_endian, floor_div, to_octets
from passband.functions.predicates import is_plottable, number_of
from passband.operators import decommutate, packets
from passband.operators.decommutate import Clock, Decommutator
from passband.plans.registry import plan
from passband.sources import definition


def tables(spark: SparkSession) -> definition.DefinitionTables:
    return definition.scan(spark, mission.publish(spark, mission.text(), "mission", "xml"))


def decoded(spark: SparkSession, folder: str, clock: Clock | None = None) -> DataFrame:
    compiled = definition.compile_definition(tables(spark))
    wire = views.packet_bytes(spark, folder).withColumn("received_ns", micros("received") * 1000)
    return Decommutator(compiled).decode(wire, clock)


RAW = "CAST(round(value * 100) AS BIGINT)"
MODE = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END"
PACKET_SQL = f"""
    SELECT *, {RAW} AS raw, {MODE} AS mode,
           CASE WHEN apid < 100 THEN 'Low' WHEN apid >= 130 AND NOT apid BETWEEN 140 AND 145 AND {MODE} < 4 THEN 'High' END AS container,
           CASE WHEN apid BETWEEN 100 AND 129 THEN 'packet type not described'
                WHEN apid BETWEEN 140 AND 145 THEN 'ambiguous packet type'
                WHEN apid >= 130 AND {MODE} = 4 THEN 'value outside its enumeration' END AS reason
    FROM tlm_packet_lossy"""
_LOW, _MID, _TOP = mission.SPLINE
_SLOPE1 = (_MID[1] - _LOW[1]) / (_MID[0] - _LOW[0])
_SLOPE2 = (_TOP[1] - _MID[1]) / (_TOP[0] - _MID[0])
ENG = f"""CASE WHEN mode = 4 THEN CAST(0.0075 AS DOUBLE) * CAST(raw AS DOUBLE) + CAST(3.5 AS DOUBLE)
    WHEN mode = 0 THEN CAST(-0.015 AS DOUBLE) * CAST(raw AS DOUBLE)
    WHEN mode = 3 AND raw <= {_MID[0]} THEN CAST({_LOW[1]} AS DOUBLE) + CAST({_SLOPE1!r} AS DOUBLE) * (CAST(raw AS DOUBLE) - CAST({_LOW[0]} AS DOUBLE))
    WHEN mode = 3 THEN CAST({_MID[1]} AS DOUBLE) + CAST({_SLOPE2!r} AS DOUBLE) * (CAST(raw AS DOUBLE) - CAST({_MID[0]} AS DOUBLE))
    ELSE CAST(0.01 AS DOUBLE) * CAST(raw AS DOUBLE) + CAST(40.0 AS DOUBLE) END"""


@plan(
    "header_fields",
    "F21 X11",
    oracle("SELECT pkt_no, apid, seq_count AS sequence, 11 AS declared_length, CAST(2048 + apid AS BIGINT) AS first_word FROM tlm_packet_lossy"),
)
def header_fields(spark: SparkSession, folder: str) -> DataFrame:
    wire = views.packet_bytes(spark, folder).select("pkt_no", "bytes")
    return packets.header(wire).select(
        "pkt_no",
        "apid",
        "sequence",
        "declared_length",
        big_endian(F.substring("bytes", 1, 2)).cast("bigint").alias("first_word"),
    )


def _rows(ordinal: int, name: str, raw: str, eng: str, label: str, where: str) -> str:
    return (
        f"SELECT pkt_no, container, {ordinal} AS ordinal, '/Mission/{name}' AS parameter, CAST({raw} AS BIGINT) AS raw, "
        f"CAST({eng} AS DOUBLE) AS eng, {label} AS label FROM packet WHERE {where}"
    )


def _plain(ordinal: int, name: str, raw: str) -> str:
    return _rows(ordinal, name, raw, raw, "CAST(NULL AS VARCHAR)", "container IS NOT NULL")


_WORD = "CASE mode WHEN 0 THEN 'VIEW' WHEN 1 THEN 'CLICK' WHEN 2 THEN 'SIGNUP' WHEN 3 THEN 'PURCHASE' ELSE 'ERROR' END"
DECOMMUTATED = "\nUNION ALL\n".join(
    [
        _plain(0, "VERSION", "0"),
        _plain(1, "TYPE", "0"),
        _plain(2, "SECONDARY", "1"),
        _plain(3, "APID", "apid"),
        _plain(4, "FLAGS", "3"),
        _plain(5, "COUNT", "seq_count"),
        _plain(6, "LENGTH", "4"),
        _rows(7, "MODE", "mode", "NULL", _WORD, "container = 'Low'"),
        _rows(8, "RAW", "raw", ENG, "CAST(NULL AS VARCHAR)", "container = 'Low'"),
        _rows(7, "SHORT_MODE", "mode", "NULL", _WORD, "container = 'High'"),
        _rows(8, "RAW_HIGH", "raw // 65536", "raw // 65536", "CAST(NULL AS VARCHAR)", "container = 'High'"),
    ]
)


@plan("decommutate", "D1 D2 D5 D6 S6", oracle(DECOMMUTATED, packet=PACKET_SQL))
def decommutated(spark: SparkSession, folder: str) -> DataFrame:
    rows = decommutate.explode_samples(decoded(spark, folder), ["pkt_no"])
    return rows.select(
        "pkt_no",
        "container",
        "ordinal",
        "parameter",
        F.col("raw.i").cast("bigint").alias("raw"),
        number_of(F.col("eng")).alias("eng"),
        F.col("eng.s").alias("label"),
    )


@plan(
    "calibrated",
    "D5 D7",
    oracle(
        f"""SELECT mode, count(*) AS samples, min({ENG}) AS lowest, max({ENG}) AS highest, true AS plottable
            FROM packet WHERE container = 'Low' GROUP BY mode""",
        packet=PACKET_SQL,
    ),
)
def calibrated(spark: SparkSession, folder: str) -> DataFrame:
    rows = decoded(spark, folder).filter(F.col("container") == "Low")
    mode, value = F.col("samples")[7]["raw"]["i"].cast("int"), F.col("samples")[8]["eng"]
    each = rows.select(mode.alias("mode"), number_of(value).alias("v"), is_plottable(value["kind"]).alias("plottable"))
    return each.groupBy("mode").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min("v").alias("lowest"),
        F.max("v").alias("highest"),
        F.bool_and("plottable").alias("plottable"),
    )


@plan(
    "reject_tally",
    "D2 D3 D6 X10",
    oracle("SELECT reason, count(*) AS packets FROM packet WHERE reason IS NOT NULL GROUP BY reason", packet=PACKET_SQL),
)
def reject_tally(spark: SparkSession, folder: str) -> DataFrame:
    return decommutate.reject_tally(decoded(spark, folder))


@plan(
    "undescribed_bits",
    "D4",
    oracle(
        "SELECT container, min(pkt_no) AS pkt_no, CAST(16 AS BIGINT) AS trailing_bits FROM packet WHERE container = 'High' GROUP BY container",
        packet=PACKET_SQL,
    ),
)
def undescribed_bits(spark: SparkSession, folder: str) -> DataFrame:
    return decommutate.undescribed(decoded(spark, folder))


@plan(
    "spacecraft_time",
    "D8 D9 X2 X5",
    oracle(
        """SELECT pkt_no, container, CASE WHEN container = 'Low' THEN (raw + 315964800) * 1000000000 END AS spacecraft,
                  CASE WHEN container = 'Low' THEN (raw + 315964800) * 1000000000 ELSE epoch_us(received) * 1000 END AS time
           FROM packet WHERE container IS NOT NULL""",
        packet=PACKET_SQL,
    ),
)
def spacecraft_time(spark: SparkSession, folder: str) -> DataFrame:
    """RAW read as whole seconds since the GPS epoch; packets without it keep receipt time."""
    layout = (("coarse_bytes", 4), ("fine_bytes", 0), ("epoch", "gps"))
    stamped = decoded(spark, folder, Clock("RAW", "cuc", layout))
    return stamped.filter(F.col("reason").isNull()).select("pkt_no", "container", "spacecraft", "time")


@plan(
    "header_observation",
    "D10",
    oracle(
        """SELECT max(received) AS last_packet, count(*) AS arrived, count(CASE WHEN pkt_no % 7 <> 3 THEN 1 END) AS with_header
           FROM tlm_packet_lossy"""
    ),
)
def header_observation(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh packet is cut to four octets: it arrived, but files nothing."""
    wire = views.packet_bytes(spark, folder).withColumn(
        "bytes",
        F.when(F.col("pkt_no") % 7 == 3, F.substring("bytes", 1, 4)).otherwise(F.col("bytes")),
    )
    return decommutate.header_observation(packets.header(wire))


TIMES_SQL = """
    SELECT event_id, epoch_us(ts) // 1000000 AS s, (epoch_us(ts) % 1000000) AS us, CAST(round(value * 100) AS BIGINT) AS fine, value FROM events"""


@plan(
    "time_codes",
    "X1 X2 X3 X4 X6",
    oracle(
        """SELECT event_id,
                  CAST(s * 1000000000 + (CAST(fine AS HUGEINT) * 1000000000) // 16777216 AS BIGINT) AS cuc,
                  CAST(s * 1000000000 + (CAST(fine AS HUGEINT) * 1000000000) // 16777216 AS BIGINT) AS cuc_number,
                  CASE WHEN event_id % 10 = 3 THEN NULL ELSE CAST(s * 1000000000 + us * 1000 AS BIGINT) END AS cds,
                  CASE WHEN event_id % 10 = 3 THEN NULL ELSE CAST(s * 1000000000 + (us // 1000) * 1000000 AS BIGINT) END AS cds_number,
                  CAST(315964800 AS BIGINT) * 1000000000 + fine * 10000000 AS seconds,
                  CAST(least(CAST(9223372036854775807 AS HUGEINT), CAST(9223372036854000000 AS HUGEINT) + fine * 1000) AS BIGINT) AS held,
                  CAST((s * 1000 + us // 1000) * 1000000 AS DOUBLE) / 1e9 AS since
           FROM t""",
        t=TIMES_SQL,
    ),
)
def time_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Instants written out as time codes and read back."""
    events = views.table(spark, folder, "events")
    us = micros("ts")
    seconds = floor_div(us, 1_000_000)
    ccsds = seconds + 378_691_200
    fine = F.round(F.col("value") * 100).cast("bigint")
    days, of_day = floor_div(ccsds, 86_400), F.pmod(ccsds, F.lit(86_400))
    sub = F.pmod(us, F.lit(1_000_000))
    # One in ten has milliseconds no day has: refused.
    millis = F.when(F.col("event_id") % 10 == 3, F.lit(86_401_000)).otherwise(
        of_day * 1000 + floor_div(sub, 1000)
    )
    wire = decommutate.staged(
        events,
        {
            "us": us,
            "fine": fine,
            "cuc": F.concat(to_octets(ccsds, 4), to_octets(fine, 3)),
            "number": (ccsds.cast("decimal(20,0)") * F.lit(1 << 24) + fine).cast("decimal(20,0)"),
            "cds": F.concat(
                to_octets(days, 2), to_octets(millis, 4), to_octets(F.pmod(sub, F.lit(1000)), 2)
            ),
            "cds_number": days * F.lit(1 << 32) + millis,
            "seconds": fine / F.lit(100.0),
        },
    )
    whole_ms = floor_div(F.col("us"), 1000) * 1_000_000
    return wire.select(
        "event_id",
        timecode.cuc_from_bytes(F.col("cuc"), 4, 3).alias("cuc"),
        timecode.cuc_from_unsigned(F.col("number"), 4, 3).alias("cuc_number"),
        timecode.cds_from_bytes(F.col("cds"), 2, 2).alias("cds"),
        timecode.cds_from_unsigned(F.col("cds_number"), 2, 0).alias("cds_number"),
        timecode.from_seconds(F.col("seconds"), "gps").alias("seconds"),
        timecode.offset(F.lit(9_223_372_036_854_000_000), F.col("fine") * 1000).alias("held"),
        timecode.seconds_since(whole_ms, F.lit(0)).alias("since"),
    )
