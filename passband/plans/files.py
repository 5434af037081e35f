"""Files in and out: limits, watch lists, definitions, CSV exports and recordings read back."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passband import schemas
from passband.fixtures import mission, views
from passband.fixtures.views import oracle
from passband.operators import decommutate, export, limits, store, watch
from passband.operators.chunks import recut
from passband.operators.decommutate import explode_samples
from passband.operators.ordered import carry
from passband.plans.decoding import DECOMMUTATED, PACKET_SQL, decoded, tables
from passband.plans.registry import plan
from passband.plans.values import LATEST_SQL, STATES_SQL, TABLE_SQL, layout
from passband.session import pin, shared_folder
from passband.sources import definition, documents, exports, recording


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/passband-files-{uuid.uuid4().hex}"


LIMITS_JSON = json.dumps(
    {
        "parameters": {
            f"/Mission/{kind}": {
                name: bound for name, bound in zip(limits.BOUNDS, bounds) if bound is not None
            }
            for kind, *bounds in views.LIMIT_ROWS
        }
    }
)


@plan(
    "limits_file",
    "S5 J1 A9",
    oracle(
        """SELECT space_system AS parameter, count(*) AS samples, max(state) AS worst FROM states GROUP BY space_system""",
        states=STATES_SQL,
    ),
)
def limits_file(spark: SparkSession, folder: str) -> DataFrame:
    """Limits of whole space systems from a JSON document, applied to every sample of them."""
    bounds = documents.limits(spark, mission.publish(spark, LIMITS_JSON, "limits", "json"))
    samples = views.samples(spark, folder).select(F.col("space_system").alias("parameter"), "eng")
    states = limits.with_state(samples, bounds)
    return states.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("samples"), F.max("state").alias("worst")
    )


WATCH_JSON = json.dumps(
    {
        "version": 1,
        "watched": [*(f"/Mission/error/U{k}" for k in range(0, 50, 5)), "/Old/GONE", "FRANCE"],
        "plots": [
            {"title": "even", "parameters": [f"/Mission/view/U{k}" for k in range(0, 40, 2)]},
            {"title": "old", "parameters": ["/Old/GONE", "/Mission/error/U5"]},
        ],
        "history_depth": 8192,
    }
)
_NAMED = sorted(
    {
        *json.loads(WATCH_JSON)["watched"],
        *(name for p in json.loads(WATCH_JSON)["plots"] for name in p["parameters"]),
    }
)


@plan(
    "watch_list_file",
    "S11 J2 J4 U2",
    oracle(
        """SELECT s.parameter, count(*) AS points FROM tlm_sample s JOIN (VALUES """
        + ", ".join(f"('{name}')" for name in _NAMED)
        + """) n(name) ON n.name = s.parameter GROUP BY 1"""
    ),
)
def watch_list_file(spark: SparkSession, folder: str) -> DataFrame:
    """A saved layout read through the scan, resolved, and the samples it keeps."""
    watched, drawn = documents.watch_list(spark, mission.publish(spark, WATCH_JSON, "watch", "json"))
    resolved = watch.resolved(watched, drawn, pin(views.definition(spark, folder)))
    kept = store.watched_samples(views.samples(spark, folder), resolved)
    return kept.groupBy("parameter").agg(F.count(F.lit(1)).alias("points"))


@plan(
    "definition_tables",
    "S6 J5",
    oracle(
        """SELECT p.parameter, e.leaf IS NOT NULL AS carried, CASE WHEN p.leaf = 'RAW' THEN 'mV' ELSE '' END AS unit
           FROM (SELECT concat('/Mission/', unnest(['VERSION', 'TYPE', 'SECONDARY', 'APID', 'FLAGS', 'COUNT', 'LENGTH', 'MODE', 'RAW', 'SHORT_MODE', 'RAW_HIGH', 'SPARE'])) AS parameter,
                        unnest(['VERSION', 'TYPE', 'SECONDARY', 'APID', 'FLAGS', 'COUNT', 'LENGTH', 'MODE', 'RAW', 'SHORT_MODE', 'RAW_HIGH', 'SPARE']) AS leaf) p
           LEFT JOIN (SELECT DISTINCT unnest(CASE container WHEN 'Low' THEN ['MODE', 'RAW', 'VERSION', 'TYPE', 'SECONDARY', 'APID', 'FLAGS', 'COUNT', 'LENGTH']
                                             ELSE ['SHORT_MODE', 'RAW_HIGH', 'VERSION', 'TYPE', 'SECONDARY', 'APID', 'FLAGS', 'COUNT', 'LENGTH'] END) AS leaf
                      FROM packet WHERE container IS NOT NULL) e ON e.leaf = p.leaf""",
        packet=PACKET_SQL,
    ),
)
def definition_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Every declared parameter, its unit, and whether any packet of the archive carries it."""
    declared = definition.parameter_table(tables(spark))
    carried = explode_samples(decoded(spark, folder), ["pkt_no"]).select("parameter").distinct()
    return declared.join(carried.withColumn("_c", F.lit(True)), "parameter", "left").select(
        "parameter", F.coalesce("_c", F.lit(False)).alias("carried"), F.array_join("units", " ").alias("unit")
    )


def _written(spark: SparkSession, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows through a CSV file and back, as text."""
    place = _place(spark)
    exports.write_csv(rows, place)
    return spark.read.schema(exports.csv_schema(columns)).options(**exports.CSV).csv(place)


STAMP = "concat(strftime({0}, '%Y-%m-%dT%H:%M:%S.'), substr(strftime({0}, '%f'), 1, 3), 'Z')"


@plan(
    "sample_export",
    "S7 S10 X7 X9",
    oracle(
        f"""SELECT {STAMP.format("p.received")} AS time, {STAMP.format("p.received")} AS received, CAST(p.apid AS VARCHAR) AS apid,
                   CAST(p.seq_count AS VARCHAR) AS sequence, d.parameter, CAST(d.raw AS VARCHAR) AS raw, d.eng, d.label
            FROM samples d JOIN packet p ON p.pkt_no = d.pkt_no""",
        packet=PACKET_SQL,
        samples=DECOMMUTATED,
    ),
)
def sample_export(spark: SparkSession, folder: str) -> DataFrame:
    """The long CSV, written and read back; numbers and labels of the last column apart."""
    rows = explode_samples(
        decoded(spark, folder).withColumnRenamed("seq_count", "sequence"), ["received_ns", "apid", "sequence"]
    )
    back = _written(spark, exports.sample_rows(rows), schemas.SAMPLE_EXPORT)
    number = F.col("eng").try_cast("double")
    return back.withColumns({"eng": number, "label": F.when(number.isNull(), F.col("eng"))})


#: Recordings of whole packets by capture, in arrival order; captures 1 and 3 end inside a packet.
_RECORDED = {
    "r": """SELECT *, apid % 4 AS capture_id, row_number() OVER (PARTITION BY apid % 4 ORDER BY pkt_no) AS k,
                   count(*) OVER (PARTITION BY apid % 4) AS n FROM tlm_packet_lossy""",
    "recorded": """SELECT pkt_no, apid, seq_count, to_timestamp((11 * k - 1) // 64) AT TIME ZONE 'UTC' AS stamp FROM r
                   WHERE capture_id % 2 = 0 OR k < n""",
}
_CHUNK, _CUT = 64, 5


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    wire = views.packet_bytes(spark, folder).select(
        (F.col("apid") % 4).alias("capture_id"), "epoch", "pkt_no", F.col("bytes").alias("octets")
    )
    keys = ["capture_id", "epoch"]
    size = F.length("octets").cast("bigint")
    placed = carry(wire, keys, "pkt_no", sums={"_end": size}).withColumn("offset", F.col("_end") - size)
    ends = placed.groupBy(*keys).agg((F.max("_end") - _CUT).alias("_last"))
    cut = recut(placed.select(*keys, "offset", "octets"), keys, _CHUNK).join(F.broadcast(ends), keys)
    # a recorder that stopped: five octets are missing at the end of every other recording
    room = F.greatest(F.col("_last") - F.col("start"), F.lit(0)).cast("int")
    held = F.when(F.col("capture_id") % 2 == 1, F.substring(F.col("octets"), F.lit(1), room)).otherwise(F.col("octets"))
    return cut.select(
        *keys, F.col("cell").alias("chunk_no"), F.col("start").alias("offset"),
        F.timestamp_seconds("cell").alias("received"), held.alias("bytes"),
    )


def exported(spark: SparkSession, folder: str) -> tuple[str, export.Summary]:
    place = _place(spark)
    decoder = decommutate.Decommutator(definition.compile_definition(tables(spark)))
    return place, export.export(recordings(spark, folder), decoder, place)


@plan(
    "recording_export",
    "S12 S7 F15 F16 D1",
    oracle(
        f"""SELECT {STAMP.format("q.stamp")} AS time, {STAMP.format("q.stamp")} AS received, CAST(q.apid AS VARCHAR) AS apid,
                   CAST(q.seq_count AS VARCHAR) AS sequence, d.parameter, CAST(d.raw AS VARCHAR) AS raw, d.eng, d.label
            FROM samples d JOIN recorded q ON q.pkt_no = d.pkt_no WHERE q.apid <> 2047""",
        packet=PACKET_SQL,
        samples=DECOMMUTATED,
        **_RECORDED,
    ),
)
def recording_export(spark: SparkSession, folder: str) -> DataFrame:
    """Whole recordings split, decoded, written as CSV and read back."""
    place, _ = exported(spark, folder)
    back = spark.read.schema(exports.csv_schema(schemas.SAMPLE_EXPORT)).options(**exports.CSV).csv(place)
    number = F.col("eng").try_cast("double")
    return back.withColumns({"eng": number, "label": F.when(number.isNull(), F.col("eng"))})


@plan(
    "export_summary",
    "A10 S12 F16",
    oracle(
        """SELECT count(*) AS packets, CAST(sum(CASE WHEN container IS NOT NULL THEN 9 ELSE 0 END) AS BIGINT) AS rows,
                  count(reason) AS rejected, (SELECT count(*) FROM packet) > (SELECT count(*) FROM recorded) AS truncated
           FROM packet p JOIN recorded q ON q.pkt_no = p.pkt_no WHERE p.apid <> 2047""",
        packet=PACKET_SQL,
        **_RECORDED,
    ),
)
def export_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What was observed while the same recordings were exported."""
    _, found = exported(spark, folder)
    row = (found.packets, found.rows, found.rejected, found.truncated)
    return spark.createDataFrame([row], "packets bigint, rows bigint, rejected bigint, truncated boolean")


@plan(
    "wanted_samples",
    "D1 D6",
    oracle("SELECT pkt_no, ordinal, parameter, raw, label FROM samples WHERE parameter IN ('/Mission/COUNT', '/Mission/MODE')", packet=PACKET_SQL, samples=DECOMMUTATED),
)
def wanted_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Two parameters of all: no other field is read but those that may refuse a packet."""
    decoder = decommutate.Decommutator(definition.compile_definition(tables(spark)))
    wire = views.packet_bytes(spark, folder).withColumn("received_ns", views.micros("received") * 1000)
    rows = explode_samples(decoder.decode(wire, wanted=["COUNT", "/Mission/MODE"]), ["pkt_no"])
    return rows.select("pkt_no", "ordinal", "parameter", F.col("raw.i").cast("bigint").alias("raw"), F.col("eng.s").alias("label"))


_LINE = 32


def _line_recording(spark: SparkSession, folder: str) -> str:
    """Files of fixed-length records as another program would leave them: numbers in text."""
    place = _place(spark)
    number = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    packets_ = views.lossy_packets(spark, folder)
    line = F.rpad(F.concat_ws(" ", number("pkt_no", 12), number("apid", 5), number("seq_count", 6)), _LINE - 1, " ")
    packets_.select(line.alias("value")).repartition(2).write.text(place)
    return place


@plan(
    "recording_scan",
    "S1",
    oracle(f"SELECT CAST(count(*) * {_LINE} AS BIGINT) AS octets, CAST(count(*) AS BIGINT) AS records, true AS contiguous FROM tlm_packet_lossy"),
)
def recording_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Raw files by byte ranges: every octet once, in chunks that follow each other within a file."""
    read = recording.scan(spark, _line_recording(spark, folder), chunk_octets=1000, range_octets=10_000)
    breaks = F.length("bytes") - F.length(F.translate(F.decode("bytes", "ISO-8859-1"), "\n", ""))
    files = read.groupBy("capture_id").agg(
        F.sum(F.length("bytes").cast("bigint")).alias("octets"),
        F.sum(breaks.cast("bigint")).alias("records"),
        F.max(F.col("offset") + F.length("bytes")).alias("end"),
        F.min("offset").alias("start"),
        (F.count_distinct("chunk_no") == F.count(F.lit(1))).alias("once"),
    )
    fits = F.bool_and((F.col("end") == F.col("octets")) & (F.col("start") == 0) & F.col("once"))
    return files.agg(F.sum("octets").alias("octets"), F.sum("records").alias("records"), fits.alias("contiguous"))


@plan(
    "fixed_records",
    "F6 S1",
    oracle("SELECT pkt_no, CAST(apid AS INTEGER) AS apid, CAST(seq_count AS INTEGER) AS seq_count FROM tlm_packet_lossy"),
)
def fixed_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every 32 octets of a file are a record, wherever its ranges are cut."""
    read = recording.fixed_records(spark, _line_recording(spark, folder), _LINE, range_octets=10_000)
    text = F.decode("frame", "US-ASCII")
    part = lambda a, n, kind: F.substring(text, a, n).cast(kind)
    return read.select(part(1, 12, "bigint").alias("pkt_no"), part(14, 5, "int").alias("apid"), part(20, 6, "int").alias("seq_count"))


@plan(
    "csv_quoting",
    "S10",
    oracle("SELECT doc_id, md5(text) AS digest FROM documents"),
)
def csv_quoting(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts with quotes, commas and line breaks through the CSV writer and back."""
    place = _place(spark)
    texts = views.table(spark, folder, "documents").select("doc_id", "text")
    exports.write_csv(texts, place)
    back = spark.read.schema("doc_id bigint, text string").options(**exports.CSV, multiLine=True).csv(place)
    return back.select("doc_id", F.md5("text").alias("digest"))


@plan(
    "snapshot",
    "S8 A4 A5 J1 J5",
    oracle(
        f"""SELECT t.parameter, {STAMP.format("t.received")} AS time, t.raw, t.eng, array_to_string(d.units, ' ') AS unit,
                   CAST(t.updates AS BIGINT) AS updates,
                   CASE t.state WHEN 0 THEN '—' WHEN 1 THEN 'ok' WHEN 2 THEN 'WARN' ELSE 'ALARM' END AS "limit"
            FROM states t JOIN tlm_definition d ON d.parameter = t.parameter""",
        latest=LATEST_SQL,
        states=TABLE_SQL,
    ),
)
def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshot CSV, written and read back, with its numbers as numbers."""
    latest = limits.with_state(store.latest(views.samples(spark, folder)), views.limits(spark, folder))
    back = _written(
        spark, exports.snapshot_rows(latest, views.definition(spark, folder)), schemas.SNAPSHOT_EXPORT
    )
    return back.withColumns(
        {
            "raw": F.col("raw").cast("double"),
            "eng": F.col("eng").cast("double"),
            "unit": F.coalesce("unit", F.lit("")),
            "updates": F.col("updates").cast("bigint"),
        }
    )


@plan(
    "history",
    "S9 W5",
    oracle(
        f"""SELECT parameter, {STAMP.format("received")} AS time, eng AS value FROM (
               SELECT parameter, received, eng, row_number() OVER (PARTITION BY parameter ORDER BY pkt_no DESC) AS age
               FROM tlm_sample WHERE parameter IN (SELECT parameter FROM tlm_watched)) h
           WHERE age <= 4096"""
    ),
)
def history(spark: SparkSession, folder: str) -> DataFrame:
    """The history CSV, written and read back: every retained point."""
    declared, names, groups = layout(spark, folder)
    points = store.bounded_history(views.samples(spark, folder), watch.resolved(names, groups, declared))
    series = points.select(
        "parameter",
        F.col("pkt_no").alias("seq_no"),
        (views.micros("received") / F.lit(1e6)).alias("t"),
        F.col("eng").alias("v"),
    )
    back = _written(spark, exports.history_rows(series), schemas.HISTORY_EXPORT)
    return back.withColumn("value", F.col("value").cast("double"))


@plan(
    "recording_round_trip",
    "S1 S4",
    oracle(
        """SELECT page_id AS capture_id, CAST(ceil(strlen(html) / 1024) AS BIGINT) AS chunks, CAST(strlen(html) AS BIGINT) AS octets FROM pages"""
    ),
)
def recording_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Captures appended to a recording, read back and cut into chunks of a kilobyte."""
    place = _place(spark)
    recording.append(views.captures(spark, folder), place)
    back = spark.read.parquet(place).withColumnRenamed("bytes", "octets")
    cut = recut(back, ["capture_id"], 1024)
    return cut.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("octets").cast("bigint")).alias("octets")
    )
