"""Values: latest, counts, histories, limits, names, tables, event lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passband.fixtures import views
from passband.fixtures.views import micros, oracle
from passband.functions import predicates, text
from passband.operators import events as log
from passband.operators import gaps, limits, store, watch
from passband.plans.quality import MISSED_SQL
from passband.plans.registry import plan
from passband.session import pin


def layout(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Definition, watched names and plot groups; the definition is written once and reused."""
    declared = pin(views.definition(spark, folder))
    return declared, views.watch(spark, folder, declared), views.plots(spark, folder, declared)


def _watched(spark: SparkSession, folder: str) -> DataFrame:
    declared, names, groups = layout(spark, folder)
    return watch.resolved(names, groups, declared)


LATEST_SQL = """
    SELECT parameter, max_by(received, pkt_no) AS received, max_by(raw, pkt_no) AS raw,
           max_by(eng, pkt_no) AS eng, count(*) AS updates
    FROM tlm_sample GROUP BY parameter"""
STATE_OF = """CASE WHEN {v} IS NULL THEN 0
    WHEN (alarm_low IS NOT NULL OR alarm_high IS NOT NULL) AND NOT ((alarm_low IS NULL OR {v} >= alarm_low) AND (alarm_high IS NULL OR {v} <= alarm_high)) THEN 3
    WHEN (warning_low IS NOT NULL OR warning_high IS NOT NULL) AND NOT ((warning_low IS NULL OR {v} >= warning_low) AND (warning_high IS NULL OR {v} <= warning_high)) THEN 2
    WHEN alarm_low IS NOT NULL OR alarm_high IS NOT NULL OR warning_low IS NOT NULL OR warning_high IS NOT NULL THEN 1 ELSE 0 END"""
STATES_SQL = f"""
    SELECT s.*, {STATE_OF.format(v="s.eng")} AS state
    FROM tlm_sample s LEFT JOIN tlm_limits l ON l.parameter = s.parameter"""
TABLE_SQL = f"""
    SELECT s.*, {STATE_OF.format(v="s.eng")} AS state
    FROM latest s LEFT JOIN tlm_limits l ON l.parameter = s.parameter"""


@plan("latest_values", "A4 D7 D8", oracle("SELECT parameter, received, raw, eng FROM latest", latest=LATEST_SQL))
def latest_values(spark: SparkSession, folder: str) -> DataFrame:
    return store.latest(views.samples(spark, folder)).drop("updates")


@plan("update_counts", "A5", oracle("SELECT parameter, least(count(*), 4294967295) AS updates FROM tlm_sample GROUP BY parameter"))
def update_counts(spark: SparkSession, folder: str) -> DataFrame:
    return store.latest(views.samples(spark, folder), columns=())


@plan(
    "seen_never_seen",
    "A6",
    oracle(
        """SELECT d.space_system, count(*) AS declared, count(s.parameter) AS seen, count(*) - count(s.parameter) AS never
           FROM tlm_definition d LEFT JOIN (SELECT DISTINCT parameter FROM tlm_sample) s ON s.parameter = d.parameter
           GROUP BY d.space_system"""
    ),
)
def seen_never_seen(spark: SparkSession, folder: str) -> DataFrame:
    declared = views.definition(spark, folder)
    seen = store.seen(views.samples(spark, folder)).withColumn("_seen", F.lit(1))
    return (
        declared.join(seen, "parameter", "left")
        .groupBy("space_system")
        .agg(
            F.count(F.lit(1)).alias("declared"),
            F.count("_seen").alias("seen"),
            (F.count(F.lit(1)) - F.count("_seen")).alias("never"),
        )
    )


@plan(
    "never_seen",
    "A6",
    oracle("SELECT parameter FROM tlm_definition WHERE parameter NOT IN (SELECT parameter FROM tlm_sample)"),
)
def never_seen(spark: SparkSession, folder: str) -> DataFrame:
    declared = views.definition(spark, folder)
    return store.never_seen(declared, views.samples(spark, folder)).select("parameter")


@plan(
    "limit_states",
    "J1 P7 X10",
    oracle(
        """SELECT space_system, state, CASE state WHEN 0 THEN '—' WHEN 1 THEN 'ok' WHEN 2 THEN 'WARN' ELSE 'ALARM' END AS label,
                  count(*) AS samples FROM states GROUP BY 1, 2, 3""",
        states=STATES_SQL,
    ),
)
def limit_states(spark: SparkSession, folder: str) -> DataFrame:
    states = limits.with_state(views.samples(spark, folder), views.limits(spark, folder))
    return states.groupBy(
        "space_system", "state", text.label(F.col("state"), text.LIMIT_LABELS).alias("label")
    ).agg(F.count(F.lit(1)).alias("samples"))


@plan(
    "limit_violations",
    "J1",
    oracle("SELECT parameter, pkt_no, eng, state FROM states WHERE state >= 2", states=STATES_SQL),
)
def limit_violations(spark: SparkSession, folder: str) -> DataFrame:
    states = limits.with_state(views.samples(spark, folder), views.limits(spark, folder))
    return states.filter(F.col("state") >= predicates.WARNING).select(
        "parameter", "pkt_no", "eng", "state"
    )


@plan(
    "worst_state_by_group",
    "A9",
    oracle("SELECT space_system, max(state) AS worst FROM states GROUP BY space_system", states=STATES_SQL),
)
def worst_state_by_group(spark: SparkSession, folder: str) -> DataFrame:
    states = limits.with_state(views.samples(spark, folder), views.limits(spark, folder))
    return limits.worst(states, ["space_system"])


@plan(
    "apid_health",
    "W1 A3 J1 A9",
    oracle(
        """SELECT m.apid, m.packets, m.gaps, m.missing, s.worst
           FROM (SELECT apid, count(*) AS packets, count(CASE WHEN missed > 0 THEN 1 END) AS gaps,
                        CAST(sum(missed) AS BIGINT) AS missing FROM missed GROUP BY apid) m
           JOIN (SELECT apid, max(state) AS worst FROM states GROUP BY apid) s ON s.apid = m.apid""",
        missed=MISSED_SQL,
        states=STATES_SQL,
    ),
)
def apid_health(spark: SparkSession, folder: str) -> DataFrame:
    """Sequence quality of each APID beside the worst state of the values it carried."""
    missed = gaps.with_missed(views.lossy_packets(spark, folder))
    quality = missed.groupBy("apid").agg(
        F.count(F.lit(1)).alias("packets"),
        F.count(F.when(F.col("missed") > 0, 1)).alias("gaps"),
        F.sum(F.col("missed").cast("bigint")).alias("missing"),
    )
    states = limits.with_state(views.samples(spark, folder), views.limits(spark, folder))
    return quality.join(limits.worst(states, ["apid"]), "apid")


@plan(
    "value_changes",
    "P8",
    oracle(
        """SELECT parameter, pkt_no, eng, previous
           FROM (SELECT *, lag(eng) OVER (PARTITION BY parameter ORDER BY pkt_no) AS previous FROM tlm_sample) s
           WHERE previous IS NULL OR previous <> eng"""
    ),
)
def value_changes(spark: SparkSession, folder: str) -> DataFrame:
    changed = store.value_changes(views.samples(spark, folder))
    return changed.select("parameter", "pkt_no", "eng", "previous")


@plan("watch_resolution", "J2", oracle("SELECT DISTINCT parameter FROM tlm_resolved"))
def watch_resolution(spark: SparkSession, folder: str) -> DataFrame:
    return _watched(spark, folder)


@plan(
    "orphans",
    "J3",
    oracle(
        """SELECT name FROM tlm_watch WHERE name NOT IN (SELECT name FROM tlm_resolved)
           UNION SELECT parameter FROM tlm_resolved"""
    ),
)
def orphans(spark: SparkSession, folder: str) -> DataFrame:
    """The kept list: orphan names beside the parameters watched now."""
    declared, names, groups = layout(spark, folder)
    return watch.captured(names, watch.resolved(names, groups, declared), declared)


@plan(
    "bounded_history",
    "W5 J4",
    oracle(
        """SELECT parameter, pkt_no, eng FROM (
               SELECT s.*, row_number() OVER (PARTITION BY parameter ORDER BY pkt_no DESC) AS age
               FROM tlm_sample s WHERE parameter IN (SELECT parameter FROM tlm_resolved)) x
           WHERE age <= 8"""
    ),
)
def bounded_history(spark: SparkSession, folder: str) -> DataFrame:
    points = store.bounded_history(views.samples(spark, folder), _watched(spark, folder), 8)
    return points.select("parameter", "pkt_no", "eng")


@plan(
    "described_samples",
    "J5",
    oracle(
        """SELECT s.parameter, d.leaf AS name, list_extract(d.units, 1) AS first_unit, array_to_string(d.units, ' ') AS unit,
                  count(*) AS samples
           FROM tlm_sample s JOIN tlm_definition d ON d.parameter = s.parameter GROUP BY 1, 2, 3, 4"""
    ),
)
def described_samples(spark: SparkSession, folder: str) -> DataFrame:
    # Counted first: the lookup then meets one row per parameter instead of every sample.
    counted = views.samples(spark, folder).groupBy("parameter").agg(F.count(F.lit(1)).alias("samples"))
    return store.describe(counted, views.definition(spark, folder))


@plan(
    "plot_members",
    "J6",
    oracle("SELECT p.plot_no, p.ordinal, r.parameter FROM tlm_plot p JOIN tlm_resolved r ON r.name = p.name"),
)
def plot_members(spark: SparkSession, folder: str) -> DataFrame:
    declared, _, groups = layout(spark, folder)
    return watch.plot_members(groups, declared)


@plan(
    "names_in_use",
    "U2",
    oracle("SELECT count(*) AS names FROM (SELECT name FROM tlm_watch UNION SELECT name FROM tlm_plot) n"),
)
def names_in_use(spark: SparkSession, folder: str) -> DataFrame:
    _, names, groups = layout(spark, folder)
    return watch.names_in_use(names, groups).agg(F.count(F.lit(1)).alias("names"))


@plan("plotted_is_watched", "U3", oracle("SELECT name FROM tlm_watch UNION SELECT name FROM tlm_plot"))
def plotted_is_watched(spark: SparkSession, folder: str) -> DataFrame:
    _, names, groups = layout(spark, folder)
    return watch.names_in_use(names, groups)


@plan(
    "name_search_topk",
    "P1 P2",
    oracle(
        """SELECT m.parameter, m.space_system, m.plottable, m.parameter IN (SELECT parameter FROM tlm_watched) AS watched,
                  l.received IS NOT NULL AS seen, l.received AS last,
                  greatest((SELECT count(*) FROM tlm_definition WHERE contains(lower(parameter), 'r/u1')) - 30, 0) AS overflow
           FROM (SELECT * FROM tlm_definition WHERE contains(lower(parameter), 'r/u1') ORDER BY declared LIMIT 30) m
           LEFT JOIN latest l ON l.parameter = m.parameter""",
        latest=LATEST_SQL,
    ),
)
def name_search_topk(spark: SparkSession, folder: str) -> DataFrame:
    declared, names, groups = layout(spark, folder)
    return store.name_search(
        declared,
        "R/u1",
        watch.resolved(names, groups, declared),
        views.samples(spark, folder),
        limit=30,
    )


@plan(
    "value_table",
    "P3",
    oracle(
        """SELECT t.parameter, t.received, t.raw, t.eng, t.updates, t.state FROM states t
           WHERE contains(lower(t.parameter), 'view') AND t.parameter IN (SELECT parameter FROM tlm_watched)""",
        latest=LATEST_SQL,
        states=TABLE_SQL,
    ),
)
def value_table(spark: SparkSession, folder: str) -> DataFrame:
    shown = store.value_table(views.samples(spark, folder), "ViEW", _watched(spark, folder))
    return limits.with_state(shown, views.limits(spark, folder))


def _table_sql(order: str) -> str:
    return oracle(
        f"SELECT parameter, received, eng, updates, state, row_number() OVER (ORDER BY {order}) AS place FROM states",
        latest=LATEST_SQL,
        states=TABLE_SQL,
    )


def _sorted_table(spark: SparkSession, folder: str, sort: str, reverse: bool = False) -> DataFrame:
    shown = limits.with_state(
        store.value_table(views.samples(spark, folder)), views.limits(spark, folder)
    )
    keys = store.sort_keys(sort, reverse)
    return store.with_places(shown.select("parameter", "received", "eng", "updates", "state"), keys)


@plan("table_by_name", "O1", _table_sql("parameter"))
def table_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return _sorted_table(spark, folder, "name")


@plan("table_by_time", "O1", _table_sql("received DESC, parameter"))
def table_by_time(spark: SparkSession, folder: str) -> DataFrame:
    return _sorted_table(spark, folder, "time")


@plan("table_by_limit", "O1", _table_sql("state DESC, parameter"))
def table_by_limit(spark: SparkSession, folder: str) -> DataFrame:
    return _sorted_table(spark, folder, "limit")


@plan("table_by_updates_reversed", "O1", _table_sql("updates ASC, parameter DESC"))
def table_by_updates_reversed(spark: SparkSession, folder: str) -> DataFrame:
    return _sorted_table(spark, folder, "updates", reverse=True)


# ------------------------------------------------------------------------------- event lines

RUNS_SQL = """
    SELECT min(seq_no) AS run, severity, source, message, max_by(event_time, seq_no) AS event_time, count(*) AS repeats
    FROM (SELECT *, sum(starts) OVER (ORDER BY seq_no) AS grp
          FROM (SELECT *, CASE WHEN severity = lag(severity) OVER w AND source = lag(source) OVER w AND message = lag(message) OVER w
                               THEN 0 ELSE 1 END AS starts
                FROM tlm_event WINDOW w AS (ORDER BY seq_no)) a) b
    GROUP BY grp, severity, source, message"""


@plan("event_collapse", "W4", oracle("SELECT run, severity, source, message, event_time, repeats FROM runs", runs=RUNS_SQL))
def event_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return log.collapse(views.events(spark, folder))


@plan(
    "event_log_newest",
    "W4",
    oracle("SELECT run, severity, source, message, event_time, repeats FROM runs ORDER BY run DESC LIMIT 2048", runs=RUNS_SQL),
)
def event_log_newest(spark: SparkSession, folder: str) -> DataFrame:
    return log.newest_runs(log.collapse(views.events(spark, folder)))


@plan(
    "event_totals",
    "A13",
    oracle("SELECT least(count(*), 2048) AS held, CAST(sum(repeats) AS BIGINT) AS total FROM runs", runs=RUNS_SQL),
)
def event_totals(spark: SparkSession, folder: str) -> DataFrame:
    return log.totals(log.collapse(views.events(spark, folder)))


@plan(
    "event_filter",
    "P4",
    oracle(
        """SELECT seq_no, severity, source, message FROM tlm_event
           WHERE severity >= 1 AND (contains(lower(message), 'e 1') OR contains(lower(source), 'e 1'))"""
    ),
)
def event_filter(spark: SparkSession, folder: str) -> DataFrame:
    shown = views.events(spark, folder).filter(log.visible(1, "E 1"))
    return shown.select("seq_no", "severity", "source", "message")


@plan(
    "quiet_log",
    "P5 X10",
    oracle(
        """SELECT source, CASE severity WHEN 1 THEN 'W' WHEN 2 THEN 'E' ELSE 'I' END AS letter, count(*) AS lines
           FROM tlm_event WHERE severity > 0 GROUP BY 1, 2"""
    ),
)
def quiet_log(spark: SparkSession, folder: str) -> DataFrame:
    said = views.events(spark, folder).filter(log.worth_saying(verbose=False))
    letter = text.label(F.col("severity"), text.SEVERITY_LETTERS)
    return said.groupBy("source", letter.alias("letter")).agg(F.count(F.lit(1)).alias("lines"))


@plan(
    "merged_log",
    "U1",
    oracle(
        """SELECT seq_no, severity, source, message FROM tlm_event
           UNION ALL
           SELECT pkt_no, 1, 'decode', concat('APID ', CAST(apid AS VARCHAR), ': ', CAST(missed AS VARCHAR), ' packet(s) missing')
           FROM missed WHERE missed > 0""",
        missed=MISSED_SQL,
    ),
)
def merged_log(spark: SparkSession, folder: str) -> DataFrame:
    missed = gaps.with_missed(views.lossy_packets(spark, folder)).filter(F.col("missed") > 0)
    message = F.concat(
        F.lit("APID "), F.col("apid").cast("string"), F.lit(": "),
        F.col("missed").cast("string"), F.lit(" packet(s) missing"),
    )
    decode = missed.select(
        F.col("pkt_no").alias("seq_no"),
        F.lit(1).alias("severity"),
        F.lit("decode").alias("source"),
        message.alias("message"),
    )
    link = views.events(spark, folder).select("seq_no", "severity", "source", "message")
    return log.merged([link, decode])


@plan(
    "text_forms",
    "X7 X8 X9",
    oracle(
        """SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.'), substr(strftime(ts, '%f'), 1, 3), 'Z') AS received,
                  CAST(year(ts) AS INTEGER) AS year, CAST(hour(ts) AS INTEGER) AS hour,
                  CASE WHEN event_id % 50 = 0 THEN 'never'
                       WHEN age < 60 THEN printf(CASE WHEN age < 10 THEN '%.1f s' ELSE '%.0f s' END, age)
                       WHEN age < 3600 THEN printf(CASE WHEN age / 60 < 10 THEN '%.1f m' ELSE '%.0f m' END, age / 60)
                       WHEN age < 86400 THEN printf(CASE WHEN age / 3600 < 10 THEN '%.1f h' ELSE '%.0f h' END, age / 3600)
                       ELSE printf(CASE WHEN age / 86400 < 10 THEN '%.1f d' ELSE '%.0f d' END, age / 86400) END AS age,
                  CASE WHEN length(props) > 8 THEN concat(lower(hex(substr(props, 1, 8))), '… (', CAST(length(props) AS VARCHAR), ' bytes)')
                       ELSE lower(hex(props)) END AS preview
           FROM (SELECT *, CAST(epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) AS DOUBLE) / 1e6 AS age FROM events) e"""
    ),
)
def text_forms(spark: SparkSession, folder: str) -> DataFrame:
    events = views.table(spark, folder, "events")
    now = F.unix_micros(events.select(F.max("ts")).scalar().cast("timestamp"))
    nanos = micros("ts") * 1000
    seconds = F.when(F.col("event_id") % 50 != 0, (now - micros("ts")) / F.lit(1e6))
    parts = text.civil(nanos)
    return events.select(
        "event_id",
        text.iso(nanos).alias("received"),
        parts["year"].alias("year"),
        parts["hour"].alias("hour"),
        text.age(seconds).alias("age"),
        text.hex_preview(F.encode("props", "UTF-8")).alias("preview"),
    )
