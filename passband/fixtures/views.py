"""The given tables seen as telemetry: packets, samples, frames, event lines.

Every view is a lazy projection of a Parquet table.  :data:`SQL` holds the same definitions for
the SQL cross-check; the two are written from one description, column by column.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from passband.functions.bits import floor_div, to_octets
from passband.operators.ordered import DEFAULT_WIDTH, carry

MODES = ("view", "click", "signup", "purchase", "error")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def packets(spark: SparkSession, folder: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Arrival-ordered packets; counts start at 16 370 so that every APID wraps."""
    events = table(spark, folder, "events").select(
        F.col("event_id").alias("pkt_no"),
        F.lit(0).alias("epoch"),
        (F.col("user_id") % 2048).cast("int").alias("apid"),
        F.col("ts").alias("received"),
        (F.length("props") + 7).cast("int").alias("pkt_len"),
        "event_type",
        "value",
    )
    numbered = carry(events, ["apid"], "pkt_no", sums={"_k": F.lit(1)}, width=width)
    return numbered.withColumn("seq_full", ((F.col("_k") + 16369) % 16384).cast("int")).drop("_k")


def lossy_packets(spark: SparkSession, folder: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """:func:`packets` with removals (gaps) and counts stepped back by one (repeats)."""
    stepped = F.when(F.col("pkt_no") % 101 == 5, (F.col("seq_full") + 16383) % 16384)
    return (
        packets(spark, folder, width)
        .filter(F.col("pkt_no") % 11 != 3)
        .select(
            "pkt_no",
            "epoch",
            "apid",
            stepped.otherwise(F.col("seq_full")).cast("int").alias("seq_count"),
            "received",
            "pkt_len",
            "event_type",
            "value",
        )
    )


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Long-form samples with a context-dependent calibration."""
    apid = (F.col("user_id") % 2048).cast("int")
    eng = (
        F.when(F.col("event_type") == "error", F.col("value") * 0.75 + 3.5)
        .when(F.col("event_type") == "view", F.col("value") * -1.5)
        .otherwise(F.col("value") + 40.0)
    )
    return table(spark, folder, "events").select(
        F.col("event_id").alias("pkt_no"),
        F.lit(0).alias("ordinal"),
        apid.alias("apid"),
        F.col("ts").alias("received"),
        F.concat(F.lit("/Mission/"), "event_type", F.lit("/U"), apid.cast("string")).alias(
            "parameter"
        ),
        F.concat(F.lit("/Mission/"), "event_type").alias("space_system"),
        F.concat(F.lit("U"), apid.cast("string")).alias("leaf"),
        F.col("value").alias("raw"),
        eng.alias("eng"),
    )


LIMIT_ROWS = (
    # event type, warning low/high, alarm low/high
    ("error", 20.0, 60.0, 12.5, 90.0),
    ("view", -100.0, None, -250.0, None),
    ("click", None, 180.0, None, 250.0),
    ("signup", None, None, None, None),
)


def limits(spark: SparkSession, folder: str) -> DataFrame:
    """One limit entry per parameter of the event types that have any."""
    rows = spark.createDataFrame(
        LIMIT_ROWS,
        "event_type string, warning_low double, warning_high double, alarm_low double, alarm_high double",
    )
    named = (
        table(spark, folder, "events")
        .select(
            "event_type",
            F.concat(
                F.lit("/Mission/"), "event_type", F.lit("/U"), (F.col("user_id") % 2048).cast("string")
            ).alias("parameter"),
        )
        .distinct()
    )
    return named.join(F.broadcast(rows), "event_type").drop("event_type")


def frames(spark: SparkSession, folder: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """A frame log: eight channels, idle and continuation pointers, access-service flags,
    drop reasons, repair counts and removed frames."""
    number = F.col("frame_no")
    raw = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("frame_no"),
        (F.col("o_custkey") % 8).cast("int").alias("vcid"),
        F.col("o_custkey").alias("_cust"),
        F.col("o_orderstatus").alias("_mark"),
        F.col("o_orderdate").alias("received"),
    )
    counted = carry(raw, ["vcid"], "frame_no", sums={"_k": F.lit(1)}, width=width)
    return counted.filter(number % 23 != 7).select(
        "frame_no",
        "vcid",
        (F.col("_k") % 256).cast("int").alias("vc_count"),
        F.when(number % 17 == 0, F.lit(2046))
        .when(number % 13 == 0, F.lit(2047))
        .otherwise(F.col("_cust") % 1000)
        .cast("int")
        .alias("fhp"),
        F.when(number % 19 == 0, 1).otherwise(0).alias("sync_flag"),
        F.when(number % 29 == 0, "rs_uncorrectable")
        .when(number % 31 == 0, "bad_checksum")
        .when(number % 37 == 0, "bad_header")
        .otherwise("ok")
        .alias("status"),
        F.when(F.col("_mark") == "F", F.col("_cust") % 5).otherwise(0).cast("int").alias("rs_symbols"),
        "received",
    )


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Byte captures, one chunk each."""
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("capture_id"),
        F.lit(0).alias("epoch"),
        F.lit(0).cast("bigint").alias("chunk_no"),
        F.lit(0).cast("bigint").alias("offset"),
        F.encode("html", "UTF-8").alias("bytes"),
    )


def slipped_captures(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`captures`, each as a receiver sees it that starts ``capture_id % 8`` bits early."""

    @pandas_udf("binary")
    def slip(octets: pd.Series, bits: pd.Series) -> pd.Series:
        out = []
        for b, n in zip(octets, bits.tolist()):
            wide = np.concatenate([[0], np.frombuffer(b, np.uint8), [0]]).astype(np.uint16)
            out.append(((wide[:-1] << (8 - n) | wide[1:] >> n) & 255).astype(np.uint8).tobytes())
        return pd.Series(out, dtype=object)

    return captures(spark, folder).withColumn("bytes", slip("bytes", F.pmod("capture_id", F.lit(8))))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Event lines with natural repeats."""
    third = F.col("user_id") % 3
    return table(spark, folder, "events").select(
        F.col("event_id").alias("seq_no"),
        F.col("ts").alias("event_time"),
        F.when(F.col("event_type") == "error", 2)
        .when(F.col("event_type") == "purchase", 1)
        .otherwise(0)
        .alias("severity"),
        F.when(third == 0, "link").when(third == 1, "frame").otherwise("decode").alias("source"),
        F.concat(F.lit("code "), F.floor(F.col("value") / 50).cast("int").cast("string")).alias("message"),
    )


def packet_bytes(spark: SparkSession, folder: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """:func:`lossy_packets` as wire packets: header, MODE u8, RAW u32 in hundredths."""
    mode = F.lit(len(MODES) - 1)
    for index, name in reversed(list(enumerate(MODES[:-1]))):
        mode = F.when(F.col("event_type") == name, index).otherwise(mode)
    wire = F.concat(
        to_octets(F.col("apid") + 2048, 2),
        to_octets(F.col("seq_count") + 49152, 2),
        F.unhex(F.lit("0004")),
        to_octets(mode, 1),
        to_octets(F.round(F.col("value") * 100), 4),
    )
    return lossy_packets(spark, folder, width).withColumn("bytes", wire)


def definition(spark: SparkSession, folder: str) -> DataFrame:
    """Declared parameters: every one the samples carry, and some no packet ever does.

    Their order is that of their numbers, and within a number of systems, not of the alphabet.
    """
    order = ["/Mission/view", "/Mission/error", "/Mission/signup", "/Mission/click", "/Mission/purchase"]
    systems = F.array_position(F.array(*map(F.lit, order)), F.col("space_system")) - 1
    seen = (
        samples(spark, folder)
        .select(
            "parameter",
            "leaf",
            "space_system",
            F.when(F.col("space_system") == "/Mission/view", F.array(F.lit("m"), F.lit("s")))
            .when(F.col("space_system") == "/Mission/error", F.array(F.lit("V")))
            .otherwise(F.array().cast("array<string>"))
            .alias("units"),
            F.lit(True).alias("plottable"),
            (F.substring("leaf", 2, 10).cast("bigint") * 10 + systems).alias("declared"),
        )
        .distinct()
    )
    spare = table(spark, folder, "nation").select(
        F.concat(F.lit("/Mission/spare/"), "n_name").alias("parameter"),
        F.col("n_name").alias("leaf"),
        F.lit("/Mission/spare").alias("space_system"),
        F.array().cast("array<string>").alias("units"),
        (F.col("n_nationkey") % 2 == 0).alias("plottable"),
        (F.lit(-1) - F.col("n_nationkey")).cast("bigint").alias("declared"),
    )
    return seen.unionByName(spare)


def watch(spark: SparkSession, folder: str, declared: DataFrame) -> DataFrame:
    """Watched names: qualified ones, leaf names, and names only an old definition had."""
    number = F.substring("leaf", 2, 10).try_cast("int")
    chosen = F.col("space_system").isin("/Mission/error", "/Mission/view")
    qualified = declared.filter(chosen & (number % 10 == 0)).select(F.col("parameter").alias("name"))
    leaves = declared.filter(number % 25 == 0).select(F.col("leaf").alias("name"))
    old = table(spark, folder, "region").select(F.concat(F.lit("/Old/"), "r_name").alias("name"))
    return qualified.union(leaves).union(old).distinct()


def plots(spark: SparkSession, folder: str, declared: DataFrame) -> DataFrame:
    """Plot groups over error parameters, some watched, some not, one group of old names."""
    number = F.substring("leaf", 2, 10).try_cast("int")
    drawn = declared.filter(
        (F.col("space_system") == "/Mission/error") & (number % 5 == 0)
    )
    groups = drawn.select(
        (number % 3).alias("plot_no"), number.alias("ordinal"), F.col("parameter").alias("name")
    )
    old = table(spark, folder, "region").select(
        F.lit(3).alias("plot_no"),
        F.col("r_regionkey").cast("int").alias("ordinal"),
        F.concat(F.lit("/Old/"), "r_name").alias("name"),
    )
    return groups.unionByName(old)


def series(spark: SparkSession, folder: str) -> DataFrame:
    """Plotted points: one series per parameter, seconds since 1970 against value."""
    return samples(spark, folder).select(
        "parameter",
        F.col("pkt_no").alias("seq_no"),
        (micros("received") / F.lit(1e6)).alias("t"),
        F.col("eng").alias("v"),
    )


# --------------------------------------------------------------------------- the same, as SQL

SQL = {
    "tlm_packet": """
        SELECT event_id AS pkt_no, 0 AS epoch, CAST(user_id % 2048 AS INTEGER) AS apid,
               CAST((16369 + row_number() OVER (PARTITION BY user_id % 2048 ORDER BY event_id)) % 16384 AS INTEGER) AS seq_full,
               ts AS received, CAST(7 + length(props) AS INTEGER) AS pkt_len, event_type, value
        FROM events""",
    "tlm_packet_lossy": """
        SELECT pkt_no, epoch, apid,
               CASE WHEN pkt_no % 101 = 5 THEN (seq_full + 16383) % 16384 ELSE seq_full END AS seq_count,
               received, pkt_len, event_type, value
        FROM tlm_packet WHERE pkt_no % 11 <> 3""",
    "tlm_sample": """
        SELECT event_id AS pkt_no, 0 AS ordinal, CAST(user_id % 2048 AS INTEGER) AS apid, ts AS received,
               concat('/Mission/', event_type, '/U', CAST(user_id % 2048 AS VARCHAR)) AS parameter,
               concat('/Mission/', event_type) AS space_system,
               concat('U', CAST(user_id % 2048 AS VARCHAR)) AS leaf, value AS raw,
               CASE event_type WHEN 'error' THEN 0.75 * value + CAST(3.5 AS DOUBLE)
                    WHEN 'view' THEN CAST(-1.5 AS DOUBLE) * value ELSE value + CAST(40.0 AS DOUBLE) END AS eng
        FROM events""",
    "tlm_limits": """
        SELECT DISTINCT concat('/Mission/', e.event_type, '/U', CAST(e.user_id % 2048 AS VARCHAR)) AS parameter,
               warning_low, warning_high, alarm_low, alarm_high
        FROM events e JOIN (VALUES
            ('error', CAST(20 AS DOUBLE), CAST(60 AS DOUBLE), CAST(12.5 AS DOUBLE), CAST(90 AS DOUBLE)),
            ('view', CAST(-100 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(-250 AS DOUBLE), CAST(NULL AS DOUBLE)),
            ('click', CAST(NULL AS DOUBLE), CAST(180 AS DOUBLE), CAST(NULL AS DOUBLE), CAST(250 AS DOUBLE)),
            ('signup', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE))
        ) AS t(event_type, warning_low, warning_high, alarm_low, alarm_high) ON t.event_type = e.event_type""",
    "tlm_frame": """
        SELECT frame_no, vcid, CAST(full_no % 256 AS INTEGER) AS vc_count,
               CAST(CASE WHEN frame_no % 17 = 0 THEN 2046 WHEN frame_no % 13 = 0 THEN 2047 ELSE cust % 1000 END AS INTEGER) AS fhp,
               CASE WHEN frame_no % 19 = 0 THEN 1 ELSE 0 END AS sync_flag,
               CASE WHEN frame_no % 29 = 0 THEN 'rs_uncorrectable' WHEN frame_no % 31 = 0 THEN 'bad_checksum'
                    WHEN frame_no % 37 = 0 THEN 'bad_header' ELSE 'ok' END AS status,
               CAST(CASE WHEN mark = 'F' THEN cust % 5 ELSE 0 END AS INTEGER) AS rs_symbols, received
        FROM (SELECT o_orderkey AS frame_no, CAST(o_custkey % 8 AS INTEGER) AS vcid, o_custkey AS cust,
                     o_orderstatus AS mark, o_orderdate AS received,
                     row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) AS full_no
              FROM orders) x
        WHERE frame_no % 23 <> 7""",
    "tlm_definition": """
        SELECT DISTINCT parameter, leaf, space_system,
               CASE space_system WHEN '/Mission/view' THEN ['m', 's'] WHEN '/Mission/error' THEN ['V'] ELSE [] END AS units,
               true AS plottable,
               CAST(substr(leaf, 2, 10) AS BIGINT) * 10 + CASE space_system WHEN '/Mission/view' THEN 0 WHEN '/Mission/error' THEN 1
                   WHEN '/Mission/signup' THEN 2 WHEN '/Mission/click' THEN 3 ELSE 4 END AS declared
        FROM tlm_sample
        UNION ALL
        SELECT concat('/Mission/spare/', n_name), n_name, '/Mission/spare', [], n_nationkey % 2 = 0, -1 - n_nationkey FROM nation""",
    "tlm_watch": """
        SELECT parameter AS name FROM tlm_definition
        WHERE space_system IN ('/Mission/error', '/Mission/view') AND TRY_CAST(substr(leaf, 2, 10) AS INTEGER) % 10 = 0
        UNION SELECT leaf FROM tlm_definition WHERE TRY_CAST(substr(leaf, 2, 10) AS INTEGER) % 25 = 0
        UNION SELECT concat('/Old/', r_name) FROM region""",
    "tlm_plot": """
        SELECT TRY_CAST(substr(leaf, 2, 10) AS INTEGER) % 3 AS plot_no, TRY_CAST(substr(leaf, 2, 10) AS INTEGER) AS ordinal, parameter AS name
        FROM tlm_definition WHERE space_system = '/Mission/error' AND TRY_CAST(substr(leaf, 2, 10) AS INTEGER) % 5 = 0
        UNION ALL SELECT 3, CAST(r_regionkey AS INTEGER), concat('/Old/', r_name) FROM region""",
    "tlm_resolved": """
        SELECT name, parameter FROM (
            SELECT n.name, coalesce(q.parameter, l.parameter) AS parameter
            FROM (SELECT name FROM tlm_watch UNION SELECT name FROM tlm_plot) n
            LEFT JOIN tlm_definition q ON q.parameter = n.name
            LEFT JOIN (SELECT leaf, min_by(parameter, declared) AS parameter FROM tlm_definition GROUP BY leaf) l ON l.leaf = n.name) r
        WHERE parameter IS NOT NULL""",
    "tlm_watched": """
        SELECT DISTINCT r.parameter FROM tlm_resolved r""",
    "tlm_series": """
        SELECT parameter, pkt_no AS seq_no, CAST(epoch_us(received) AS DOUBLE) / 1e6 AS t, eng AS v FROM tlm_sample""",
    "tlm_event": """
        SELECT event_id AS seq_no, ts AS event_time,
               CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS severity,
               CASE WHEN user_id % 3 = 0 THEN 'link' WHEN user_id % 3 = 1 THEN 'frame' ELSE 'decode' END AS source,
               concat('code ', CAST(CAST(floor(value / 50) AS INTEGER) AS VARCHAR)) AS message
        FROM events""",
}


def oracle(sql: str, **extra: str) -> str:
    """Put the definitions ``sql`` mentions (directly or not) in front of it as CTEs."""
    known = {**SQL, **extra}
    chosen: dict[str, str] = {}
    open_names: set[str] = set()

    def need(text: str) -> None:
        for name in known:
            if name not in open_names and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                open_names.add(name)
                need(known[name])
                chosen[name] = known[name]

    need(sql)
    if not chosen:
        return sql.strip()
    head = ",\n".join(f"{name} AS ({body.strip()})" for name, body in chosen.items())
    return f"WITH {head}\n{sql.strip()}"
