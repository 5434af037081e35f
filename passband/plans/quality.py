"""Link quality: sequence gaps, dropouts, channel continuity, statistics, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passband.fixtures import views
from passband.fixtures.views import micros, oracle
from passband.functions.bits import floor_div
from passband.operators import channels, gaps, link
from passband.plans.registry import plan

MISSED_SQL = """
    SELECT *, CASE WHEN prev IS NULL OR prev = seq_count THEN 0
                   ELSE (seq_count - prev - 1 + 16384) % 16384 END AS missed
    FROM (SELECT *, lag(seq_count) OVER (PARTITION BY epoch, apid ORDER BY pkt_no) AS prev,
                 row_number() OVER (PARTITION BY epoch, apid ORDER BY pkt_no) AS rn
          FROM tlm_packet_lossy) p"""


@plan(
    "apid_gap_report",
    "W1 A3",
    oracle(
        """SELECT apid, count(*) AS packets, count(CASE WHEN missed > 0 THEN 1 END) AS gaps,
                  CAST(sum(missed) AS BIGINT) AS missing FROM missed GROUP BY apid""",
        missed=MISSED_SQL,
    ),
)
def apid_gap_report(spark: SparkSession, folder: str) -> DataFrame:
    missed = gaps.with_missed(views.lossy_packets(spark, folder))
    return missed.groupBy("apid").agg(
        F.count(F.lit(1)).alias("packets"),
        F.count(F.when(F.col("missed") > 0, 1)).alias("gaps"),
        F.sum(F.col("missed").cast("bigint")).alias("missing"),
    )


@plan(
    "sequence_gaps",
    "W1",
    oracle("SELECT apid, pkt_no, CAST(rn AS BIGINT) AS rn, CAST(missed AS INTEGER) AS missed FROM missed WHERE missed > 0", missed=MISSED_SQL),
)
def sequence_gaps(spark: SparkSession, folder: str) -> DataFrame:
    missed = gaps.with_missed(views.lossy_packets(spark, folder))
    return missed.filter(F.col("missed") > 0).select("apid", "pkt_no", "rn", "missed")


@plan(
    "probe_apid_tally",
    "W2 A2",
    oracle(
        """SELECT apid, count(*) AS packets, min(pkt_len) AS shortest, max(pkt_len) AS longest,
                  count(CASE WHEN step > 0 THEN 1 END) AS gaps, CAST(sum(step) AS BIGINT) AS missing
           FROM (SELECT *, coalesce((seq_count - lag(seq_count) OVER (PARTITION BY apid ORDER BY pkt_no) - 1 + 16384) % 16384, 0) AS step
                 FROM tlm_packet_lossy) p
           GROUP BY apid"""
    ),
)
def probe_apid_tally(spark: SparkSession, folder: str) -> DataFrame:
    return gaps.apid_tally(views.lossy_packets(spark, folder))


@plan(
    "gap_totals",
    "A3",
    oracle(
        """SELECT count(CASE WHEN missed > 0 THEN 1 END) AS gaps, CAST(sum(missed) AS BIGINT) AS missing
           FROM missed""",
        missed=MISSED_SQL,
    ),
)
def gap_totals(spark: SparkSession, folder: str) -> DataFrame:
    return gaps.gap_totals(gaps.with_missed(views.lossy_packets(spark, folder)))


def _dropout_sql(healthy: int, every: int) -> str:
    return oracle(
        f"""SELECT epoch, apid, rn, CASE WHEN gaps = 1 THEN 'first' ELSE 'running' END AS kind,
                   CAST(seq_count AS INTEGER) AS seq_count, gaps, missing
            FROM run WHERE gaps = 1 OR gaps % {every} = 0
            UNION ALL
            SELECT r.epoch, r.apid, r.rn + {healthy}, 'recovered', CAST(NULL AS INTEGER), r.gaps, r.missing
            FROM run r JOIN (SELECT epoch, apid, max(rn) AS arrived FROM missed GROUP BY epoch, apid) a
                 ON a.epoch = r.epoch AND a.apid = r.apid
            WHERE (r.next_rn IS NULL OR r.next_rn > r.rn + {healthy}) AND a.arrived >= r.rn + {healthy}""",
        missed=MISSED_SQL,
        marked=f"""SELECT *, CASE WHEN before IS NULL OR rn - before > {healthy} THEN 1 ELSE 0 END AS starts
                   FROM (SELECT *, lag(rn) OVER w AS before, lead(rn) OVER w AS next_rn FROM missed WHERE missed > 0
                         WINDOW w AS (PARTITION BY epoch, apid ORDER BY rn)) g""",
        numbered="SELECT *, sum(starts) OVER (PARTITION BY epoch, apid ORDER BY rn) AS session FROM marked",
        run="""SELECT epoch, apid, CAST(rn AS BIGINT) AS rn, seq_count, next_rn,
                      count(*) OVER w AS gaps, CAST(sum(missed) OVER w AS BIGINT) AS missing
               FROM numbered WINDOW w AS (PARTITION BY epoch, apid, session ORDER BY rn)""",
    )


@plan("dropout_sessions", "W3", _dropout_sql(64, 64))
def dropout_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return gaps.dropout_sessions(views.lossy_packets(spark, folder))


@plan("dropout_sessions_short", "W3", _dropout_sql(9, 4))
def dropout_sessions_short(spark: SparkSession, folder: str) -> DataFrame:
    """The same with short runs, so that recoveries and running totals occur often."""
    return gaps.dropout_sessions(
        views.lossy_packets(spark, folder), healthy_run=9, summary_interval=4
    )


@plan(
    "first_packets",
    "O2",
    oracle("SELECT pkt_no, apid, seq_count, pkt_len FROM tlm_packet_lossy ORDER BY pkt_no LIMIT 20"),
)
def first_packets(spark: SparkSession, folder: str) -> DataFrame:
    packets = views.lossy_packets(spark, folder)
    return packets.select("pkt_no", "apid", "seq_count", "pkt_len").orderBy("pkt_no").limit(20)


@plan(
    "packet_limit",
    "O3",
    oracle("SELECT apid, count(*) AS packets FROM tlm_packet WHERE pkt_no < 5000 GROUP BY apid"),
)
def packet_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Stop after 5 000 packets: a predicate on the ordinal, pushed to the scan."""
    events = views.table(spark, folder, "events").filter(F.col("event_id") < 5000)
    return events.groupBy((F.col("user_id") % 2048).cast("int").alias("apid")).agg(
        F.count(F.lit(1)).alias("packets")
    )


CONTINUITY_SQL = """
    SELECT *, CASE WHEN prev IS NULL THEN false ELSE (vc_count - prev - 1 + 256) % 256 = 0 END AS contiguous,
           CAST(coalesce((vc_count - prev - 1 + 256) % 256, 0) AS INTEGER) AS missing
    FROM (SELECT *, lag(vc_count) OVER (PARTITION BY vcid ORDER BY frame_no) AS prev
          FROM tlm_frame WHERE status = 'ok') f"""


@plan(
    "vc_continuity",
    "F12",
    oracle(
        """SELECT vcid, frame_no, vc_count, contiguous, missing FROM continuity
           WHERE NOT contiguous""",
        continuity=CONTINUITY_SQL,
    ),
)
def vc_continuity(spark: SparkSession, folder: str) -> DataFrame:
    parsed = views.frames(spark, folder).filter(F.col("status") == "ok")
    return (
        channels.with_continuity(parsed)
        .filter(~F.col("contiguous"))
        .select("vcid", "frame_no", "vc_count", "contiguous", "missing")
    )


ROUTE_SQL = """CASE WHEN sync_flag = 1 THEN 'access_service' WHEN fhp = 2046 THEN 'idle'
                    WHEN fhp = 2047 THEN 'continuation' ELSE 'start' END"""


@plan(
    "frame_routes",
    "F13",
    oracle(
        f"""SELECT vcid, {ROUTE_SQL} AS route, count(*) AS frames, CAST(sum(missing) AS BIGINT) AS missing
            FROM continuity GROUP BY 1, 2""",
        continuity=CONTINUITY_SQL,
    ),
)
def frame_routes(spark: SparkSession, folder: str) -> DataFrame:
    parsed = views.frames(spark, folder).filter(F.col("status") == "ok")
    routed = channels.with_continuity(parsed).withColumn(
        "route", channels.route(F.col("sync_flag"), F.col("fhp"))
    )
    return routed.groupBy("vcid", "route").agg(
        F.count(F.lit(1)).alias("frames"), F.sum(F.col("missing").cast("bigint")).alias("missing")
    )


@plan(
    "channel_first_seen",
    "W7",
    oracle(
        """SELECT vcid, min(frame_no) AS frame_no, min_by(received, frame_no) AS received
           FROM tlm_frame WHERE sync_flag = 1 AND status = 'ok' GROUP BY vcid"""
    ),
)
def channel_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    return channels.first_access_service(
        views.frames(spark, folder).filter(F.col("status") == "ok")
    )


FRAME_COUNTERS_SQL = """
    count(*) AS frames_seen, count(CASE WHEN status = 'ok' THEN 1 END) AS frames_ok,
    count(CASE WHEN status <> 'ok' THEN 1 END) AS frames_dropped,
    count(CASE WHEN rs_symbols > 0 AND status <> 'rs_uncorrectable' THEN 1 END) AS rs_corrected,
    CAST(coalesce(sum(CASE WHEN status <> 'rs_uncorrectable' THEN rs_symbols END), 0) AS BIGINT) AS rs_symbols,
    count(CASE WHEN status = 'rs_uncorrectable' THEN 1 END) AS rs_uncorrectable,
    count(CASE WHEN status = 'bad_checksum' THEN 1 END) AS crc_failures,
    count(CASE WHEN status = 'ok' AND sync_flag = 0 AND fhp = 2046 THEN 1 END) AS idle_frames"""


@plan(
    "frame_loss",
    "A7",
    oracle(
        """SELECT vcid, frames_seen, frames_dropped, CAST(frames_dropped AS DOUBLE) / frames_seen AS loss,
                  CAST(frames_dropped AS DOUBLE) / frames_seen > 0.01 AS flagged
           FROM c""",
        c=f"SELECT vcid, {FRAME_COUNTERS_SQL} FROM tlm_frame GROUP BY vcid",
    ),
)
def frame_loss(spark: SparkSession, folder: str) -> DataFrame:
    loss = link.frame_loss(F.col("frames_seen"), F.col("frames_dropped"))
    return link.frame_counters(views.frames(spark, folder), ["vcid"]).select(
        "vcid",
        "frames_seen",
        "frames_dropped",
        loss.alias("loss"),
        (loss > link.FRAME_LOSS_WARNING).alias("flagged"),
    )


@plan(
    "correction_depth",
    "A8",
    oracle(
        """SELECT vcid, rs_symbols, rs_corrected,
                  CASE WHEN rs_corrected = 0 THEN 0 ELSE CAST(rs_symbols AS DOUBLE) / rs_corrected END AS depth
           FROM c""",
        c=f"SELECT vcid, {FRAME_COUNTERS_SQL} FROM tlm_frame GROUP BY vcid",
    ),
)
def correction_depth(spark: SparkSession, folder: str) -> DataFrame:
    return link.frame_counters(views.frames(spark, folder), ["vcid"]).select(
        "vcid",
        "rs_symbols",
        "rs_corrected",
        link.correction_depth(F.col("rs_symbols"), F.col("rs_corrected")).alias("depth"),
    )


@plan(
    "liveness",
    "A11",
    oracle(
        """SELECT apid, CASE WHEN silence <= 3 THEN 'live' WHEN silence <= 30 THEN 'quiet' ELSE 'stopped' END AS state,
                  silence AS silence_seconds
           FROM (SELECT apid, CAST(epoch_us(now) - epoch_us(last) AS DOUBLE) / 1e6 AS silence
                 FROM (SELECT apid, max(received) AS last, (SELECT max(received) FROM tlm_packet) AS now
                       FROM tlm_packet GROUP BY apid) a) b"""
    ),
)
def liveness(spark: SparkSession, folder: str) -> DataFrame:
    """State of each APID at the instant the archive ends."""
    events = views.table(spark, folder, "events")
    now = F.unix_micros(events.select(F.max("ts")).scalar().cast("timestamp"))
    last = events.groupBy((F.col("user_id") % 2048).cast("int").alias("apid")).agg(
        F.max("ts").alias("last"), F.min("ts").alias("opened")
    )
    stamps = (now, micros("last"), micros("opened"))
    return last.select(
        "apid",
        link.liveness(*stamps).alias("state"),
        link.silence_seconds(*stamps).alias("silence_seconds"),
    )


TICKS_SQL = """
    SELECT tick, CAST(sum(b) OVER (ORDER BY tick) AS BIGINT) AS bytes, CAST(sum(n) OVER (ORDER BY tick) AS BIGINT) AS packets
    FROM (SELECT epoch_us(received) // 500 // 500000 AS tick, sum(pkt_len) AS b, count(*) AS n
          FROM tlm_packet GROUP BY 1) t"""


@plan(
    "rates",
    "W6",
    oracle(
        """SELECT tick, CASE WHEN tick > tick0 THEN CAST(bytes - bytes0 AS DOUBLE) / ((tick - tick0) * CAST(0.5 AS DOUBLE)) ELSE 0 END AS bytes_per_second,
                  CASE WHEN tick > tick0 THEN CAST(packets - packets0 AS DOUBLE) / ((tick - tick0) * CAST(0.5 AS DOUBLE)) ELSE 0 END AS packets_per_second
           FROM (SELECT *, first(tick) OVER w AS tick0, first(bytes) OVER w AS bytes0, first(packets) OVER w AS packets0
                 FROM ticks WINDOW w AS (ORDER BY tick RANGE BETWEEN 10 PRECEDING AND CURRENT ROW)) r""",
        ticks=TICKS_SQL,
    ),
)
def rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of the archive played back 500 times faster than it was received."""
    arrivals = views.table(spark, folder, "events").select(
        floor_div(micros("ts"), 500).alias("at_us"), (F.length("props") + 7).alias("pkt_len")
    )
    ticks = link.counter_ticks(arrivals, at_us="at_us", length="pkt_len")
    return link.rates(ticks)
