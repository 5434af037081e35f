"""The counters of a link: one row per stream from the tables of all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passband.fixtures import views, wire
from passband.operators import frames, gaps, link, markers, packets
from passband.plans.decoding import PACKET_SQL, decoded
from passband.plans.framing import FRAME, LAYOUT, STREAM_SQL, UNIT, wire_oracle
from passband.plans.quality import FRAME_COUNTERS_SQL, MISSED_SQL
from passband.plans.registry import plan
from passband.session import pin

_NAMES = ", ".join(
    f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in link.COUNTERS
)


@plan(
    "link_stats",
    "A1 F4 F14 D3",
    wire_oracle(
        f"""SELECT s.capture_id, {_NAMES}, last_packet FROM s
            LEFT JOIN f ON f.capture_id = s.capture_id LEFT JOIN a ON a.capture_id = s.capture_id
            LEFT JOIN d ON d.capture_id = s.capture_id LEFT JOIN g ON g.capture_id = s.capture_id""",
        total=f"SELECT capture_id, epoch, count(*) * {UNIT} + count(*) // 40 * 17 AS octets, count(*) AS n FROM tlm_frames GROUP BY capture_id, epoch",
        found="SELECT capture_id, epoch, count(CASE WHEN r % 40 NOT IN (10, 25) THEN 1 END) AS sync_found FROM locked GROUP BY capture_id, epoch",
        # noise before rank 39 of forty: five places on from there nothing is found where it should be
        lost=f"""SELECT capture_id, epoch, count(CASE WHEN (39 + 40 * j) * {UNIT} + j * 17 + 5 * {UNIT} <= octets THEN 1 END) AS sync_lost
                 FROM (SELECT *, unnest(range(n // 40)) AS j FROM total) t GROUP BY capture_id, epoch""",
        s="""SELECT capture_id, sum(octets) AS bytes_in, sum(sync_found) AS sync_found, sum(sync_lost) AS sync_lost
             FROM total LEFT JOIN found USING (capture_id, epoch) LEFT JOIN lost USING (capture_id, epoch) GROUP BY capture_id""",
        f=f"SELECT vcid % 4 AS capture_id, {FRAME_COUNTERS_SQL} FROM tlm_frame GROUP BY 1",
        a="""SELECT capture_id, count(CASE WHEN whole AND apid <> 2047 THEN 1 END) AS packets_in, count(CASE WHEN whole AND apid = 2047 THEN 1 END) AS idle_packets,
                    count(CASE WHEN begun AND NOT whole THEN 1 END) AS packets_lost FROM tlm_fate GROUP BY capture_id""",
        d="SELECT apid % 4 AS capture_id, count(container) AS packets_decoded, count(reason) AS packets_rejected FROM packet GROUP BY 1",
        g="""SELECT apid % 4 AS capture_id, count(CASE WHEN missed > 0 THEN 1 END) AS sequence_gaps, sum(missed) AS sequence_missing,
                    max(received) AS last_packet FROM missed GROUP BY 1""",
        packet=PACKET_SQL,
        missed=MISSED_SQL,
        **STREAM_SQL,
    ),
)
def link_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and locks of the recordings, the frame log, what assembly made of the frames, what the
    definition made of the packets, and their gaps: each stage aggregated by itself, then merged."""
    recorded = wire.recording(spark, folder)
    totals = recorded.groupBy(*wire.CAPTURE_KEYS).agg(F.max(F.col("offset") + F.length("bytes")).alias("total"))
    starts = markers.frame_starts(markers.scan(recorded), totals, FRAME)
    parsed = pin(frames.parse(wire.frames(spark, folder), LAYOUT).filter(F.col("status") == "ok"))
    read = packets.segments(parsed)
    whole = packets.header(packets.segment_packets(read))
    key = ["capture_id"]
    by_apid = lambda df: df.withColumn("capture_id", F.col("apid") % 4)
    stages = [
        markers.sync_counters(starts, totals, FRAME).drop("epoch"),
        link.frame_counters(views.frames(spark, folder).withColumn("capture_id", F.col("vcid") % 4), key),
        link.assembly_counters(whole, packets.segment_losses(read), key),
        link.decode_counters(by_apid(decoded(spark, folder)), key),
        link.gap_counters(by_apid(gaps.with_missed(views.lossy_packets(spark, folder))), key),
    ]
    return link.link_stats(stages, key)
