"""The same results out of streams: every one must equal the batch query over the same rows."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passband.fixtures import views, wire
from passband.fixtures.views import oracle
from passband.functions.bits import floor_div
from passband.operators import frames as tm
from passband.operators import packets
from passband.plans.framing import CHANCE_SQL, CUT_SQL, FRAME, LAYOUT, STREAM_SQL, messages_of, wire_oracle
from passband.plans.quality import _dropout_sql
from passband.plans.registry import plan
from passband.plans.values import LATEST_SQL
from passband.session import shared_folder
from passband.sources import recording as files
from passband.streaming import assembly, gaps, status, sync


#: Micro-batches that the staged queries are cut into, and files of each.
BATCHES, FILES = 3, 4


def stage(df: DataFrame, order: str) -> str:
    """Store rows as files in arrival order, for a file stream to pick up a few at a time.

    The rows are computed once and range-partitioned.  A file stream takes files by their time, so
    the files, which are written side by side, get times in the order of their ranges.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/passband-stream-{uuid.uuid4().hex}"
    ranged = df.repartitionByRange(BATCHES * FILES, order).sortWithinPartitions(order)
    ranged.write.parquet(f"{folder}/in")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/in")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(str(f.getPath()) for f in store.listStatus(path) if "/part-" in str(f.getPath()))
    now = int(time.time()) * 1000
    for i, name in enumerate(names):
        place = spark._jvm.org.apache.hadoop.fs.Path(name)
        store.setTimes(place, now - 1000 * (len(names) - i), -1)
    return folder


def source(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/in")


def drain(rows: DataFrame, folder: str) -> DataFrame:
    """Run a stream over everything stored, in several micro-batches, into files; read them."""
    query = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/out")


def newest(rows: DataFrame, folder: str, keys: list[str], values: list[str]) -> DataFrame:
    """Run an updating stream to its end; the last row of every key, open windows included."""

    def save(batch: DataFrame, number: int) -> None:
        # Named by batch: a repeated micro-batch replaces what it wrote before.
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        rows.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = rows.sparkSession.read.parquet(f"{folder}/out/batch=*")
    return written.groupBy(*keys).agg(*[F.max_by(c, "_batch").alias(c) for c in values])


def _stream_of(spark: SparkSession, df: DataFrame, order: str) -> tuple[str, DataFrame]:
    folder = stage(df, order)
    return folder, source(spark, folder, df.schema)


@plan("stream_dropouts", "R1 R5 S2", _dropout_sql(9, 4))
def stream_dropouts(spark: SparkSession, folder: str) -> DataFrame:
    packets = views.lossy_packets(spark, folder).select("epoch", "apid", "pkt_no", "seq_count")
    place, rows = _stream_of(spark, packets, "pkt_no")
    return drain(gaps.dropouts(rows, healthy_run=9, summary_interval=4), place)


@plan("stream_latest_values", "R2", oracle("SELECT parameter, raw, eng, updates FROM latest", latest=LATEST_SQL))
def stream_latest_values(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming aggregate in update mode, written once per micro-batch; the newest row wins."""
    samples = views.samples(spark, folder).select("parameter", "pkt_no", "ordinal", "raw", "eng")
    place, rows = _stream_of(spark, samples, "pkt_no")
    return newest(status.store.latest(rows, columns=("raw", "eng")), place, ["parameter"], ["raw", "eng", "updates"])


@plan(
    "stream_assembly",
    "R3 F14",
    wire_oracle("SELECT CAST(capture_id AS BIGINT) AS capture_id, vcid, frame_no, size AS octets FROM tlm_fate WHERE whole"),
)
def stream_assembly(spark: SparkSession, folder: str) -> DataFrame:
    parsed = tm.parse(wire.frames(spark, folder), LAYOUT).filter(F.col("status") == "ok")
    needed = parsed.select(
        F.col("capture_id").cast("bigint").alias("capture_id"), "epoch", "vcid", "frame_no", "received", "vc_count", "sync_flag", "fhp", "data"
    )
    place, rows = _stream_of(spark, needed, "frame_no")
    made = drain(assembly.assemble(rows), place)
    return made.filter(F.col("pkt_index") >= 0).select("capture_id", "vcid", "frame_no", F.length("bytes").alias("octets"))


@plan(
    "stream_losses",
    "R8 F16",
    wire_oracle(
        """SELECT CAST(sum(CASE WHEN begun AND NOT whole THEN 1 ELSE 0 END) AS BIGINT) AS lost,
                  CAST(sum(CASE WHEN NOT whole THEN held ELSE 0 END) AS BIGINT) AS discarded FROM tlm_fate"""
    ),
)
def stream_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Losses counted while running, and what was still open when the stream ended."""
    parsed = tm.parse(wire.frames(spark, folder), LAYOUT).filter(F.col("status") == "ok")
    needed = parsed.select("capture_id", "epoch", "vcid", "frame_no", "received", "vc_count", "sync_flag", "fhp", "data")
    place, rows = _stream_of(spark, needed, "frame_no")
    made = drain(assembly.assemble(rows), place)
    open_ones = assembly.still_open(spark, f"{place}/state")
    both = made.select("lost", "discarded").unionByName(open_ones.select("lost", "discarded"))
    return both.agg(
        F.sum(F.col("lost").cast("bigint")).alias("lost"), F.sum(F.col("discarded").cast("bigint")).alias("discarded")
    )


@plan(
    "stream_sync",
    "R4 S2 S4",
    wire_oracle(CUT_SQL, **STREAM_SQL, **CHANCE_SQL),
)
def stream_sync(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks replayed from the store and cut into frames as they come, checksums holding."""
    chunks = wire.recording(spark, folder).withColumn("capture_id", F.col("capture_id").cast("bigint"))
    place = stage(chunks, "chunk_no")
    rows = files.replay(spark, f"{place}/in", files_per_trigger=FILES)
    cut = drain(sync.synchronise(rows, FRAME), place)
    good = tm.parse(cut, LAYOUT).filter(F.col("status") == "ok")
    return good.select("capture_id", "start", "found")


@plan(
    "stream_rates",
    "R9",
    oracle(
        """SELECT w AS start_us, CAST(sum(pkt_len) AS DOUBLE) / 5 AS bytes_per_second, CAST(count(*) AS DOUBLE) / 5 AS packets_per_second
           FROM (SELECT unnest(range(us // 500000 * 500000 - 4500000, us // 500000 * 500000 + 1, 500000)) AS w, pkt_len
                 FROM (SELECT epoch_us(ts) // 500 AS us, CAST(7 + length(props) AS INTEGER) AS pkt_len FROM events) e) x
           GROUP BY w"""
    ),
)
def stream_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Sliding windows of the archive played back 500 times faster, those still open at its end too."""
    arrivals = views.table(spark, folder, "events").select(
        F.col("event_id").alias("pkt_no"),
        F.timestamp_micros(floor_div(views.micros("ts"), 500)).alias("received"),
        (F.length("props") + 7).cast("int").alias("pkt_len"),
    )
    place, rows = _stream_of(spark, arrivals, "pkt_no")
    return newest(
        status.windowed_rates(rows).select(F.unix_micros("window.start").alias("start_us"), "bytes_per_second", "packets_per_second"),
        place,
        ["start_us"],
        ["bytes_per_second", "packets_per_second"],
    )


@plan(
    "restart_epochs",
    "R5",
    oracle(
        """SELECT pkt_no, apid, CAST(sum(CASE WHEN pkt_no % 1000 = 999 THEN 1 ELSE 0 END) OVER (ORDER BY pkt_no) AS BIGINT) AS epoch
           FROM tlm_packet_lossy"""
    ),
)
def restart_epochs(spark: SparkSession, folder: str) -> DataFrame:
    packets = views.lossy_packets(spark, folder).select("pkt_no", "apid", (F.col("pkt_no") % 1000 == 999).alias("restart"))
    return status.with_epochs(packets, [], "pkt_no").drop("restart")


@plan(
    "stream_status",
    "R6",
    oracle("SELECT apid % 4 AS capture_id, count(*) AS packets_in, CAST(sum(pkt_len) AS BIGINT) AS bytes_in, max(received) AS last_packet FROM tlm_packet_lossy GROUP BY 1"),
)
def stream_status(spark: SparkSession, folder: str) -> DataFrame:
    """Status lines of the last micro-batch of each stream."""
    packets = views.lossy_packets(spark, folder).select(
        (F.col("apid") % 4).alias("capture_id"), "pkt_no", "pkt_len", F.col("received").cast("timestamp").alias("received")
    )
    place, rows = _stream_of(spark, packets, "pkt_no")
    return newest(status.status_lines(rows), place, ["capture_id"], ["packets_in", "bytes_in", "last_packet"])


@plan(
    "stream_messages",
    "S3 F15",
    oracle(
        """SELECT pkt_no // 4 AS msg_id, CAST(count(*) - CASE WHEN pkt_no // 4 % 10 = 3 THEN 1 ELSE 0 END AS BIGINT) AS packets
           FROM tlm_packet_lossy GROUP BY pkt_no // 4
           HAVING count(*) - CASE WHEN pkt_no // 4 % 10 = 3 THEN 1 ELSE 0 END > 0"""
    ),
)
def stream_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages as they come, each split by itself; nothing is kept between them."""
    stored = messages_of(spark, folder).select(
        F.col("msg_id").cast("bigint").alias("msg_id"), F.timestamp_seconds("msg_id").alias("received"), "bytes"
    )
    place = stage(stored, "msg_id")
    rows = files.messages(spark, f"{place}/in", FILES)
    whole = packets.message_packets(packets.walked(rows, max_length=4096), ["msg_id"])
    made = drain(whole.select("msg_id"), place)
    return made.groupBy("msg_id").agg(F.count(F.lit(1)).alias("packets"))


#: Seconds of silence of the replay, a tenth and less of those on a live link.
LIVE, QUIET, PATIENCE = 0.5, 1.5, 120.0


@plan(
    "stream_silence",
    "R7 A11",
    oracle(
        """SELECT c.capture_id, s.step, s.state FROM (SELECT DISTINCT apid % 4 AS capture_id FROM tlm_packet_lossy) c
           CROSS JOIN (VALUES (1, 'live'), (2, 'quiet'), (3, 'stopped')) s(step, state)"""
    ),
)
def stream_silence(spark: SparkSession, folder: str) -> DataFrame:
    """What every stream was from its last packet on: timers tell, for no rows come any more.

    The query runs until each stream has stopped.
    """
    arrivals = views.lossy_packets(spark, folder).select((F.col("apid") % 4).alias("capture_id"), "pkt_no")
    place, rows = _stream_of(spark, arrivals, "pkt_no")
    streams = arrivals.select("capture_id").distinct().count()
    schema = "capture_id int, state string, at_ms bigint"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    def told() -> DataFrame:
        lines = spark.read.schema(schema).parquet(f"{place}/out/batch=*")
        last = lines.filter("state = 'live'").groupBy("capture_id").agg(F.max("at_ms").alias("_last"))
        return lines.join(last, "capture_id").filter(F.col("at_ms") >= F.col("_last")).drop("_last")

    query = (
        status.silence(rows, live=LIVE, quiet=QUIET)
        .writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", f"{place}/state")
        .trigger(processingTime="200 milliseconds")
        .start()
    )
    try:
        end = time.time() + PATIENCE
        while time.time() < end and not query.awaitTermination(1):
            done = query.recentProgress and query.recentProgress[-1].numInputRows == 0
            if done and told().filter("state = 'stopped'").count() == streams:
                break
    finally:
        query.stop()
    step = F.when(F.col("state") == "live", 1).when(F.col("state") == "quiet", 2).otherwise(3)
    return told().select("capture_id", step.alias("step"), "state")
