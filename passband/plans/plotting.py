"""Plots: windows with anchors, extremes, reductions, the grid and its accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passband.fixtures import views
from passband.fixtures.views import oracle
from passband.operators import series, simplify, store, watch
from passband.plans.registry import plan
from passband.plans.values import layout

LOW, HIGH = 1_704_500_000.0, 1_705_900_000.0


@plan(
    "window_with_anchors",
    "P6",
    oracle(
        f"""SELECT parameter, seq_no, t, v FROM (
                SELECT *, max(CASE WHEN t < {LOW} THEN seq_no END) OVER (PARTITION BY parameter) AS a,
                       min(CASE WHEN t > {HIGH} THEN seq_no END) OVER (PARTITION BY parameter) AS b FROM tlm_series) s
            WHERE t BETWEEN {LOW} AND {HIGH} OR seq_no = a OR seq_no = b"""
    ),
)
def window_with_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return series.select_window(views.series(spark, folder), LOW, HIGH)


@plan(
    "follow_window",
    "A14",
    oracle("SELECT min(t) AS low, max(t) AS high FROM tlm_series WHERE parameter IN (SELECT parameter FROM tlm_watched)"),
)
def follow_window(spark: SparkSession, folder: str) -> DataFrame:
    declared, names, groups = layout(spark, folder)
    points = store.watched_samples(views.series(spark, folder), watch.resolved(names, groups, declared))
    return series.follow_window(points, F.lit(0.0))


def _by_system(spark: SparkSession, folder: str) -> DataFrame:
    """One long series per space system."""
    return views.samples(spark, folder).select(
        F.col("space_system").alias("parameter"),
        F.col("pkt_no").alias("seq_no"),
        (views.micros("received") / F.lit(1e6)).alias("t"),
        F.col("eng").alias("v"),
    )


@plan(
    "minmax_preselect",
    "T2",
    oracle(
        """SELECT parameter, part, idx, seq_no, t, v FROM (
               SELECT parameter, 1 AS part, idx, seq_no, t, v FROM b
               WHERE idx = lo OR idx = hi
               UNION ALL SELECT parameter, 0, idx, seq_no, t, v FROM p WHERE idx = 0
               UNION ALL SELECT parameter, 2, idx, seq_no, t, v FROM p WHERE idx = n - 1) u""",
        p="""SELECT space_system AS parameter, pkt_no AS seq_no, CAST(epoch_us(received) AS DOUBLE) / 1e6 AS t, eng AS v,
                    row_number() OVER (PARTITION BY space_system ORDER BY pkt_no) - 1 AS idx,
                    count(*) OVER (PARTITION BY space_system) AS n FROM tlm_sample""",
        edges="""SELECT parameter, b AS bucket, CAST(floor(b * (CAST(n AS DOUBLE) / 248)) AS BIGINT) AS low, CAST(floor((b + 1) * (CAST(n AS DOUBLE) / 248)) AS BIGINT) AS high
                 FROM (SELECT DISTINCT parameter, n FROM p) d CROSS JOIN range(248) r(b)""",
        q="SELECT p.*, e.bucket FROM p JOIN edges e ON e.parameter = p.parameter AND p.idx >= e.low AND p.idx < e.high",
        b="""SELECT *, first_value(idx) OVER (PARTITION BY parameter, bucket ORDER BY v, idx) AS lo,
                    first_value(idx) OVER (PARTITION BY parameter, bucket ORDER BY v DESC, idx) AS hi FROM q""",
    ),
)
def minmax_preselect(spark: SparkSession, folder: str) -> DataFrame:
    """Extremes of 248 buckets (a budget of 64 points, ratio 4) of five long series."""
    placed = series.indexed(_by_system(spark, folder))
    return series.min_max(placed, 64).select("parameter", "part", "idx", "seq_no", "t", "v")


_SYSTEMS = "SELECT space_system AS parameter, pkt_no AS seq_no, CAST(epoch_us(received) AS DOUBLE) / 1e6 AS t, eng AS v FROM tlm_sample"


def _placed_sql(points: str, key: str = "parameter", order: str = "seq_no") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS idx,
                      count(*) OVER (PARTITION BY {key}) AS n FROM ({points}) i"""


def _min_max_sql(threshold: int, key: str = "parameter", ratio: int = series.RATIO) -> dict[str, str]:
    """CTEs after p (placed points): u, the extremes of buckets and the ends, with part and idx."""
    count = max(threshold - 2, 1) * ratio
    on = " AND ".join(f"p.{c} = e.{c}" for c in key.split(", "))
    return {
        "edges": f"""SELECT {key}, b AS bucket, CAST(floor(b * (CAST(n AS DOUBLE) / {count})) AS BIGINT) AS low,
                            CAST(floor((b + 1) * (CAST(n AS DOUBLE) / {count})) AS BIGINT) AS high
                     FROM (SELECT DISTINCT {key}, n FROM p) d CROSS JOIN range({count}) r(b)""",
        "q": f"SELECT p.*, e.bucket FROM p JOIN edges e ON {on} AND p.idx >= e.low AND p.idx < e.high",
        "b": f"""SELECT *, first_value(idx) OVER (PARTITION BY {key}, bucket ORDER BY v, idx) AS lo,
                        first_value(idx) OVER (PARTITION BY {key}, bucket ORDER BY v DESC, idx) AS hi FROM q""",
        "u": f"""SELECT {key}, 1 AS part, idx, seq_no, t, v FROM b WHERE (idx = lo OR idx = hi) AND n > {threshold * ratio}
                 UNION ALL SELECT {key}, 1, idx, seq_no, t, v FROM p WHERE n <= {threshold * ratio}
                 UNION ALL SELECT {key}, 0, idx, seq_no, t, v FROM p WHERE idx = 0 AND n > {threshold * ratio}
                 UNION ALL SELECT {key}, 2, idx, seq_no, t, v FROM p WHERE idx = n - 1 AND n > {threshold * ratio}""",
    }


def _lttb_sql(threshold: int, placed: str, key: str = "parameter") -> dict[str, str]:
    """CTEs that follow the chain of anchors over ``placed`` (idx, n, t, v); chain has the points kept."""
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in key.split(", "))
    of = lambda a: ", ".join(f"{a}.{c}" for c in key.split(", "))
    every = f"(CAST(n - 2 AS DOUBLE) / {threshold - 2})"
    return {
        "lz": f"""SELECT *, t - first_value(t) OVER (PARTITION BY {key} ORDER BY idx) AS x FROM ({placed}) i WHERE n > {threshold}""",
        "le": f"""SELECT {key}, b AS bucket, CAST(floor(b * {every}) AS BIGINT) AS low, CAST(floor((b + 1) * {every}) AS BIGINT) AS high
                  FROM (SELECT DISTINCT {key}, n FROM lz) d CROSS JOIN range({threshold - 1}) r(b)""",
        "lb": f"SELECT lz.*, le.bucket FROM lz JOIN le ON {on('lz', 'le')} AND idx > 0 AND idx - 1 >= low AND idx - 1 < high",
        "lg": f"SELECT {key}, bucket - 1 AS bucket, avg(x) AS gx, avg(v) AS gv FROM lb GROUP BY {key}, bucket",
        "chain": f"""SELECT {key}, CAST(-1 AS BIGINT) AS bucket, struct_pack(i := idx, s := seq_no, t := t, v := v, x := x) AS w FROM lz WHERE idx = 0
            UNION ALL
            SELECT {of('c')}, lb.bucket, max_by(struct_pack(i := lb.idx, s := lb.seq_no, t := lb.t, v := lb.v, x := lb.x),
                   struct_pack(a := abs((c.w.x - gx) * (lb.v - c.w.v) - (c.w.x - lb.x) * (gv - c.w.v)), i := -lb.idx))
            FROM chain c JOIN lb ON {on('c', 'lb')} AND lb.bucket = c.bucket + 1 AND lb.bucket < {threshold - 2}
                 JOIN lg ON {on('lg', 'lb')} AND lg.bucket = lb.bucket
            GROUP BY {of('c')}, lb.bucket""",
        "kept": f"""SELECT {key}, w.s AS seq_no, w.t AS t, w.v AS v FROM chain
            UNION ALL SELECT {key}, seq_no, t, v FROM lz WHERE idx = n - 1
            UNION ALL SELECT {key}, seq_no, t, v FROM ({placed}) i WHERE n <= {threshold}""",
    }


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@plan("lttb", "T1", _recursive(oracle("SELECT * FROM kept", p=_placed_sql(_SYSTEMS), **_lttb_sql(128, "SELECT * FROM p"))))
def lttb(spark: SparkSession, folder: str) -> DataFrame:
    return simplify.lttb(_by_system(spark, folder), 128)


_REDUCED = "SELECT * EXCLUDE (part, idx), row_number() OVER (PARTITION BY {0} ORDER BY part, idx) - 1 AS idx, count(*) OVER (PARTITION BY {0}) AS n FROM u"


@plan(
    "min_max_lttb",
    "T2",
    _recursive(
        oracle("SELECT * FROM kept", p=_placed_sql(_SYSTEMS), **_min_max_sql(128), **_lttb_sql(128, _REDUCED.format("parameter")))
    ),
)
def min_max_lttb(spark: SparkSession, folder: str) -> DataFrame:
    return series.min_max_lttb(_by_system(spark, folder), 128)


@plan(
    "rdp",
    "T3",
    _recursive(
        oracle(
            "SELECT DISTINCT p.parameter, seq_no, t, v FROM p JOIN (SELECT parameter, a AS idx FROM cuts UNION SELECT parameter, b FROM cuts) k ON k.parameter = p.parameter AND k.idx = p.idx",
            p=_placed_sql(_SYSTEMS),
            z="SELECT *, t - first_value(t) OVER (PARTITION BY parameter ORDER BY idx) AS x FROM p",
            cuts="""SELECT a.parameter, a.idx AS a, a.x AS ax, a.v AS av, b.idx AS b, b.x AS bx, b.v AS bv
                FROM z a JOIN z b ON a.parameter = b.parameter AND a.idx = 0 AND b.idx = b.n - 1
                UNION ALL
                SELECT parameter, CASE WHEN side = 0 THEN a ELSE w.i END, CASE WHEN side = 0 THEN ax ELSE w.x END, CASE WHEN side = 0 THEN av ELSE w.v END,
                       CASE WHEN side = 0 THEN w.i ELSE b END, CASE WHEN side = 0 THEN w.x ELSE bx END, CASE WHEN side = 0 THEN w.v ELSE bv END
                FROM (SELECT parameter, a, ax, av, b, bx, bv, max_by(struct_pack(i := i, x := x, v := v), struct_pack(f := far, i := -i)) AS w, max(far) AS most
                      FROM (SELECT c.*, z.idx AS i, z.x AS x, z.v AS v,
                                   CASE WHEN bx = ax AND bv = av THEN sqrt((z.x - ax) * (z.x - ax) + (z.v - av) * (z.v - av))
                                        ELSE abs((bx - ax) * (av - z.v) - (ax - z.x) * (bv - av)) / sqrt((bx - ax) * (bx - ax) + (bv - av) * (bv - av)) END AS far
                            FROM cuts c JOIN z ON z.parameter = c.parameter AND z.idx > c.a AND z.idx < c.b) y
                      GROUP BY parameter, a, ax, av, b, bx, bv HAVING max(far) > 60.0) x CROSS JOIN (VALUES (0), (1)) s(side)""",
        )
    ),
)
def rdp(spark: SparkSession, folder: str) -> DataFrame:
    return simplify.rdp(_by_system(spark, folder), 60.0)


def _grid(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    declared, names, groups = layout(spark, folder)
    members = watch.plot_members(groups, declared)
    samples = views.samples(spark, folder)
    history = store.bounded_history(samples, watch.resolved(names, groups, declared)).select(
        "parameter",
        F.col("pkt_no").alias("seq_no"),
        (views.micros("received") / F.lit(1e6)).alias("t"),
        F.col("eng").alias("v"),
    )
    return series.plot_grid(history, members, points=64, low=LOW, high=HIGH)


_GRID_KEY = "plot_no, ordinal, parameter"


@plan(
    "plot_grid",
    "T4 J4 J6 W5 P6",
    _recursive(
        oracle(
            "SELECT * FROM kept",
            h="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY seq_no DESC) AS age FROM tlm_series) x
                 WHERE age <= 4096""",
            g=f"""SELECT m.plot_no, m.ordinal, m.parameter, s.seq_no, s.t, s.v
                  FROM (SELECT *, max(CASE WHEN t < {LOW} THEN seq_no END) OVER (PARTITION BY parameter) AS a,
                               min(CASE WHEN t > {HIGH} THEN seq_no END) OVER (PARTITION BY parameter) AS b FROM h) s
                  JOIN (SELECT p.plot_no, p.ordinal, r.parameter FROM tlm_plot p JOIN tlm_resolved r ON r.name = p.name) m
                       ON m.parameter = s.parameter
                  WHERE s.t BETWEEN {LOW} AND {HIGH} OR s.seq_no = s.a OR s.seq_no = s.b""",
            p=_placed_sql("SELECT * FROM g", _GRID_KEY),
            **_min_max_sql(64, _GRID_KEY),
            **_lttb_sql(64, _REDUCED.format(_GRID_KEY), _GRID_KEY),
        )
    ),
)
def plot_grid(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder)[1]


@plan(
    "decimation_accounting",
    "A12 T4",
    oracle(
        f"""SELECT plot_no, CAST(sum(n) AS BIGINT) AS considered, CAST(sum(least(n, 64)) AS BIGINT) AS drawn FROM (
               SELECT m.plot_no, m.ordinal, m.parameter, count(*) AS n
               FROM (SELECT *, max(CASE WHEN t < {LOW} THEN seq_no END) OVER (PARTITION BY parameter) AS a,
                            min(CASE WHEN t > {HIGH} THEN seq_no END) OVER (PARTITION BY parameter) AS b FROM h) s
               JOIN (SELECT p.plot_no, p.ordinal, r.parameter FROM tlm_plot p JOIN tlm_resolved r ON r.name = p.name) m
                    ON m.parameter = s.parameter
               WHERE s.t BETWEEN {LOW} AND {HIGH} OR s.seq_no = s.a OR s.seq_no = s.b
               GROUP BY 1, 2, 3) g GROUP BY plot_no""",
        h="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY seq_no DESC) AS age FROM tlm_series) x
             WHERE age <= 4096""",
    ),
)
def decimation_accounting(spark: SparkSession, folder: str) -> DataFrame:
    return series.accounting(*_grid(spark, folder))
