"""Whole series reduced by LTTB and by Ramer-Douglas-Peucker, without holding a series anywhere.

Both rules are sequential: a bucket's point depends on the one chosen before, a segment on the split
that made it.  A series is cut into slices of bounded size.  What crosses from slice to slice is small:
for LTTB a map from every way into a slice to its way out, for RDP the segments that are still open.
Every series is reduced in this one way, however short or long it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passband.functions.bits import floor_div
from passband.operators.lookup import dimension
from passband.operators.ordered import DEFAULT_WIDTH
from passband.operators.series import KEYS, bucket_of, indexed
from passband.session import pin

#: Points of one hull, of one slice of the chain and of one block.
PIECE = SLICE_POINTS = BLOCK_POINTS = 1 << 16
#: Blocks a segment may touch to be split to the end by one task: a million points, 24 MB.
SPAN = 16
#: Areas computed at once.
CELLS = 1 << 22


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


# ------------------------------------------------------------------------------------------ LTTB


def hull(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Positions of the points that can be furthest from some line: the hull, collinear ones included,
    the first point, and the first that is not a number."""
    numbers = np.flatnonzero(~np.isnan(v))
    keep = {0, *np.flatnonzero(np.isnan(v))[:1].tolist()}
    order = numbers[np.lexsort((v[numbers], x[numbers]))]
    px, pv = x[order].tolist(), v[order].tolist()
    for sign in (1.0, -1.0):
        chain: list[int] = []
        for i in range(len(px)):
            while len(chain) > 1:
                a, b = chain[-2], chain[-1]
                cross = (px[b] - px[a]) * (pv[i] - pv[a]) - (pv[b] - pv[a]) * (px[i] - px[a])
                if sign * cross >= 0:
                    break
                chain.pop()
            chain.append(i)
        keep |= set(order[chain].tolist())
    return np.array(sorted(keep), np.int64)


def chosen(ax: np.ndarray, av: np.ndarray, x: np.ndarray, v: np.ndarray, goal_x: float, goal_v: float) -> np.ndarray:
    """For every anchor the candidate of the largest triangle; the first of equal ones."""
    out = np.empty(len(ax), np.int64)
    step = max(1, CELLS // len(x))
    with np.errstate(invalid="ignore", over="ignore"):
        for at in range(0, len(ax), step):
            p, q = ax[at : at + step, None], av[at : at + step, None]
            area = np.abs((p - goal_x) * (v - q) - (p - x) * (goal_v - q))
            out[at : at + step] = np.where(np.isnan(area), -1.0, area).argmax(axis=1)
    return out


def _buckets(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[pd.DataFrame]]:
    """The ways into a slice, and its buckets in turn."""
    rows = rows.sort_values(["bucket", "idx"], kind="stable")
    inside = rows[~rows["entry"]]
    return rows[rows["entry"]], [g for _, g in inside.groupby("bucket", sort=True)]


def lttb(points: DataFrame, threshold: int, keys: Sequence[str] = KEYS, *, width: int = DEFAULT_WIDTH, piece: int = PIECE, slice_points: int = SLICE_POINTS) -> DataFrame:
    """At most ``threshold`` points of every series by largest-triangle-three-buckets.

    The area is linear in the candidate, so only the hull of a bucket can hold the largest: pieces of
    at most ``piece`` points leave their hulls.  Hulls are strung into slices of about
    ``slice_points`` points.  Each slice tells where every way into it leads; the one way taken is
    followed over the slices' answers; then all slices name their points.  A NaN area is never the
    largest; a series of at most ``threshold`` points is kept whole.
    """
    names = [*keys, "seq_no", "t", "v"]
    placed = indexed(points.select(*names), keys, width=width)
    last = F.col("idx") == F.col("n") - 1
    if threshold < 3:
        return placed.filter((F.col("n") <= threshold) | (F.col("idx") == 0) | last).select(*names)
    placed = pin(placed)
    whole = placed.filter(F.col("n") <= threshold).select(*names)
    long = placed.filter(F.col("n") > threshold)
    origin = dimension(long.filter("idx = 0").select(*keys, F.col("t").alias("_t0"), F.col("v").alias("_v0")))
    inner = (
        long.filter("idx > 0")
        .withColumn("bucket", bucket_of(F.col("idx") - 1, (F.col("n") - 2) / F.lit(float(threshold - 2))))
        .join(origin.drop("_v0"), list(keys))
        .withColumn("x", F.col("t") - F.col("_t0"))
    )
    means = inner.groupBy(*keys, "bucket").agg(F.avg("x").alias("goal_x"), F.avg("v").alias("goal_v"))

    shape = [*keys, "bucket", "idx", "seq_no", "t", "v", "x"]
    cut = inner.filter(F.col("bucket") < threshold - 2).select(*shape, floor_div(F.col("idx"), piece).alias("_piece"))

    def corner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        return pdf.iloc[hull(pdf["x"].to_numpy(), pdf["v"].to_numpy())][shape]

    hulls = pin(cut.groupBy(*keys, "bucket", "_piece").applyInPandas(corner, T.StructType(_fields(cut, shape))))

    # Buckets are dealt to slices by the points they have left; a bucket stays whole.
    along = Window.partitionBy(*keys).orderBy("bucket")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    sizes = hulls.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("_n"))
    dealt = sizes.withColumn("slice", floor_div(F.coalesce(F.sum("_n").over(before), F.lit(0)), slice_points))
    ranked = dealt.withColumn("slice", F.dense_rank().over(Window.partitionBy(*keys).orderBy("slice")) - 1)
    goals = means.withColumn("bucket", F.col("bucket") - 1).filter("bucket >= 0")
    plan = dimension(
        ranked.withColumn("_next", F.lead("slice").over(along))
        .join(goals, [*keys, "bucket"])
        .select(*keys, "bucket", "slice", (F.col("_next") > F.col("slice")).alias("_leads"), "goal_x", "goal_v")
    )
    joined = hulls.join(plan, [*keys, "bucket"])
    spread = F.when(F.col("_leads"), F.array("slice", F.col("slice") + 1)).otherwise(F.array("slice"))
    columns = [*shape, "goal_x", "goal_v"]
    rows = joined.select(*columns, F.col("slice").alias("_own"), F.explode(spread).alias("slice"))
    rows = rows.select(*columns, "slice", (F.col("slice") > F.col("_own")).alias("entry"))
    start = long.filter("idx = 0").select(
        *keys, F.lit(-1).cast("bigint").alias("bucket"), "idx", "seq_no", "t", "v", F.lit(0.0).alias("x"),
        *(F.lit(None).cast("double").alias(c) for c in ("goal_x", "goal_v")),
        F.lit(0).alias("slice"), F.lit(True).alias("entry"),
    )
    sliced = pin(rows.withColumn("slice", F.col("slice").cast("int")).unionByName(start.withColumn("slice", F.col("slice").cast("int"))))

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        """Runs of ways into the slice, by place in the series, that leave it by the same way."""
        into, buckets = _buckets(pdf)
        way = np.arange(len(into))  # of each entry, the anchor it has led to
        ax, av, at = (into[c].to_numpy() for c in ("x", "v", "idx"))
        for b in buckets:
            x, v = b["x"].to_numpy(), b["v"].to_numpy()
            picked = chosen(ax, av, x, v, b["goal_x"].iloc[0], b["goal_v"].iloc[0])
            some, place = np.unique(picked, return_inverse=True)
            way = place[way]
            ax, av, at = x[some], v[some], b["idx"].to_numpy()[some]
        out, first = at[way], into["idx"].to_numpy()
        cuts = np.flatnonzero(np.diff(out)) + 1
        lows, highs = np.append(0, cuts), np.append(cuts, len(out)) - 1
        made = pd.DataFrame({"slice": pdf["slice"].iloc[0], "low": first[lows], "high": first[highs], "out": out[lows]})
        return made.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "slice", "low", "high", "out"]]

    kinds = [T.StructField("slice", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("low", "high", "out"))]
    ways = sliced.groupBy(*keys, "slice").applyInPandas(through, T.StructType([*_fields(points, keys), *kinds]))

    def followed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, out = pdf.sort_values(["slice", "low"]), 0, []
        for number, part in pdf.groupby("slice", sort=True):
            out.append((number, at))
            at = int(part["out"].iloc[int(part["low"].searchsorted(at, side="right")) - 1])
        made = pd.DataFrame(out, columns=["slice", "_from"])
        return made.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "slice", "_from"]]

    kinds = [T.StructField("slice", T.IntegerType()), T.StructField("_from", T.LongType())]
    taken = dimension(ways.groupBy(*keys).applyInPandas(followed, T.StructType([*_fields(points, keys), *kinds])))

    def named(pdf: pd.DataFrame) -> pd.DataFrame:
        into, buckets = _buckets(pdf)
        here = into[into["idx"] == into["_from"]]
        x, v, out = here["x"].to_numpy(), here["v"].to_numpy(), []
        for b in buckets:
            bx, bv = b["x"].to_numpy(), b["v"].to_numpy()
            at = int(chosen(x, v, bx, bv, b["goal_x"].iloc[0], b["goal_v"].iloc[0])[0])
            x, v = bx[at : at + 1], bv[at : at + 1]
            out.append(b.iloc[at : at + 1])
        return pd.concat(out)[names]

    found = sliced.join(taken, [*keys, "slice"]).filter(~F.col("entry") | (F.col("idx") == F.col("_from")))
    kept = found.groupBy(*keys, "slice").applyInPandas(named, T.StructType(_fields(points, names)))
    ends = long.filter((F.col("idx") == 0) | last).select(*names)
    return whole.unionByName(ends).unionByName(kept)


# ------------------------------------------------------------------------------------------- RDP

SEGMENT = ("a", "ax", "av", "b", "bx", "bv")


def off_line(x: np.ndarray, v: np.ndarray, ax: float, av: float, bx: float, bv: float) -> np.ndarray:
    """Distances of points from the line through two; one that is not a number is none."""
    norm = np.hypot(bx - ax, bv - av)
    with np.errstate(invalid="ignore", over="ignore"):
        if norm == 0.0:
            distance = np.hypot(x - ax, v - av)
        else:
            distance = np.abs((bx - ax) * (av - v) - (ax - x) * (bv - av)) / norm
    return np.where(np.isnan(distance), 0.0, distance)


def split_marks(x: np.ndarray, v: np.ndarray, epsilon: float) -> np.ndarray:
    """Points at which a segment of a series is split; the first of equally distant ones is."""
    marks, stack = np.zeros(len(x), dtype=bool), [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        if b <= a + 1:
            continue
        distance = off_line(x[a + 1 : b], v[a + 1 : b], x[a], v[a], x[b], v[b])
        worst = int(np.argmax(distance))
        if distance[worst] > epsilon:
            marks[a + 1 + worst] = True
            stack += [(a, a + 1 + worst), (a + 1 + worst, b)]
    return marks


def rdp(points: DataFrame, epsilon: float, keys: Sequence[str] = KEYS, *, width: int = DEFAULT_WIDTH, block: int = BLOCK_POINTS, span: int = SPAN) -> DataFrame:
    """Simplify every series so that no dropped point is further than ``epsilon`` from the line.

    Points are written once, in blocks of ``block``.  A segment over more than ``span`` blocks asks each
    of them for its furthest point, and the furthest of all splits it: per level only segments move.
    One over fewer blocks gets its points and is split to the end by one task, for each further level
    over all blocks would be a round of jobs; one that lies within a block is split to the end there.
    """
    if span < 1:
        raise ValueError(f"span must be at least 1, got {span}")
    names = [*keys, "seq_no", "t", "v"]
    placed = indexed(points.select(*names), keys, width=width).withColumn("_block", floor_div(F.col("idx"), block))
    point = F.struct("idx", "t", "v", "seq_no")
    blocks = pin(
        placed.groupBy(*keys, "_block")
        .agg(F.sort_array(F.collect_list(point)).alias("_p"))
        .select(*keys, "_block", *(F.col(f"_p.{c}").alias(c) for c in ("idx", "t", "v", "seq_no")))
    )
    first, final = F.struct(F.element_at("t", 1).alias("t"), F.element_at("v", 1).alias("v")), F.struct(
        F.element_at("idx", -1).alias("idx"), F.element_at("t", -1).alias("t"), F.element_at("v", -1).alias("v")
    )
    corners = blocks.groupBy(*keys).agg(F.min_by(first, "_block").alias("_a"), F.max_by(final, "_block").alias("_b"))
    origin = dimension(corners.select(*keys, F.col("_a.t").alias("_t0")))
    zero = F.lit(0)
    segments = corners.select(
        *keys, zero.cast("bigint").alias("a"), F.lit(0.0).alias("ax"), F.col("_a.v").alias("av"),
        F.col("_b.idx").alias("b"), (F.col("_b.t") - F.col("_a.t")).alias("bx"), F.col("_b.v").alias("bv"),
    )
    shifted_blocks = blocks.join(origin, list(keys))
    # a block asks about the points strictly between the ends of a segment
    low, high = floor_div(F.col("a") + 1, block), floor_div(F.col("b") - 1, block)
    found_fields = [*_fields(points, keys), *T.StructType.fromDDL("a bigint, far double, w bigint, wx double, wv double").fields]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                one = {c: batch[c][i].as_py() for c in (*SEGMENT, "_t0")}
                idx, t, v = (batch[c][i].values.to_numpy() for c in ("idx", "t", "v"))
                lo, hi = np.searchsorted(idx, [one["a"] + 1, one["b"]])
                x = t[lo:hi] - one["_t0"]
                far = off_line(x, v[lo:hi], *(one[c] for c in ("ax", "av", "bx", "bv")))
                k = int(far.argmax())
                rows.append((float(far[k]), int(idx[lo + k]), float(x[k]), float(v[lo + k])))
            parts = list(zip(*rows)) or [()] * 4
            kinds = (pa.float64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*(batch[k] for k in keys), batch["a"], *(pa.array(p, k) for p, k in zip(parts, kinds))],
                names=[f.name for f in found_fields],
            )

    local: DataFrame | None = None
    gathered: DataFrame | None = None
    split_rows: DataFrame | None = None
    open_ones = pin(segments.filter(F.col("b") > F.col("a") + 1))
    while True:
        here = open_ones.filter(low == high)
        local = here if local is None else local.unionByName(here)
        some = open_ones.filter((low < high) & (high - low < span))
        gathered = some if gathered is None else gathered.unionByName(some)
        wide = open_ones.filter((low < high) & (high - low >= span))
        if wide.isEmpty():
            break
        routed = dimension(wide.withColumn("_block", F.explode(F.sequence(low, high))))
        answers = shifted_blocks.join(routed, [*keys, "_block"]).mapInArrow(asked, T.StructType(found_fields))
        worst = (
            answers.filter(F.col("far") > epsilon)
            .groupBy(*keys, "a")
            .agg(F.max_by(F.struct("w", "wx", "wv"), F.struct("far", -F.col("w"))).alias("_w"))
        )
        halves = pin(wide.join(dimension(worst), [*keys, "a"]))
        middle = halves.select(*keys, F.col("_w.w").alias("idx"))
        split_rows = middle if split_rows is None else split_rows.unionByName(middle)
        w = [F.col(f"_w.{c}") for c in ("w", "wx", "wv")]
        left = halves.select(*keys, "a", "ax", "av", *(c.alias(n) for c, n in zip(w, SEGMENT[3:])))
        right = halves.select(*keys, *(c.alias(n) for c, n in zip(w, SEGMENT[:3])), "b", "bx", "bv")
        open_ones = pin(left.unionByName(right).filter(F.col("b") > F.col("a") + 1))

    # what lies within a few blocks: their points between the ends of a segment come together
    held = [*keys, *SEGMENT]

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                idx = batch["idx"][i].values.to_numpy()
                lo, hi = np.searchsorted(idx, [batch["a"][i].as_py() + 1, batch["b"][i].as_py()])
                x = batch["t"][i].values.to_numpy()[lo:hi] - batch["_t0"][i].as_py()
                parts = [pa.array([p]) for p in (x, batch["v"][i].values.to_numpy()[lo:hi])]
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(row[c] for c in (*held, "_block")), *parts], names=[*held, "_block", "x", "v"])

    def split_whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, one = pdf.sort_values("_block"), pdf.iloc[0]
        x, v = (np.concatenate([[one[f"a{c}"]], *pdf[c], [one[f"b{c}"]]]) for c in ("x", "v"))
        marks = np.flatnonzero(split_marks(x, v, epsilon)) + one["a"]
        return pd.DataFrame({**{k: one[k] for k in keys}, "idx": marks})[[*keys, "idx"]]

    routed = dimension(gathered.withColumn("_block", F.explode(F.sequence(low, high))))
    brought = shifted_blocks.join(routed, [*keys, "_block"]).select(*held, "_block", "idx", "t", "v", "_t0")
    few = T.StructType([*_fields(brought, [*held, "_block"]), *T.StructType.fromDDL("x array<double>, v array<double>").fields])
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inner = brought.mapInArrow(between, few).repartition(parts, *keys, "a").groupBy(*keys, "a")
    ends = pin(inner.applyInPandas(split_whole, T.StructType([*_fields(points, keys), T.StructField("idx", T.LongType())])))
    split_rows = ends if split_rows is None else split_rows.unionByName(ends)

    # what lies within one block: at most one segment per two of its points
    grouped = local.withColumn("_block", low).groupBy(*keys, "_block").agg(F.collect_list(F.struct(*SEGMENT)).alias("_s"))
    work = shifted_blocks.join(grouped, [*keys, "_block"], "left")
    marks = split_rows.withColumn("_block", floor_div(F.col("idx"), block))
    work = work.join(marks.groupBy(*keys, "_block").agg(F.collect_list("idx").alias("_m")), [*keys, "_block"], "left")
    lengths = corners.select(*keys, F.col("_b.idx").alias("_last"))
    work = work.join(dimension(lengths), list(keys))
    out_schema = T.StructType(_fields(points, names))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                idx, t, v = (batch[c][i].values.to_numpy() for c in ("idx", "t", "v"))
                keep = np.isin(idx, [0, batch["_last"][i].as_py(), *(batch["_m"][i].as_py() or ())])
                x = t - batch["_t0"][i].as_py()
                for s in batch["_s"][i].as_py() or ():
                    lo, hi = np.searchsorted(idx, [s["a"] + 1, s["b"]])
                    part_x, part_v = (np.concatenate([[s["a" + c]], p[lo:hi], [s["b" + c]]]) for c, p in (("x", x), ("v", v)))
                    keep[lo:hi] |= split_marks(part_x, part_v, epsilon)[1:-1]
                at = pa.array(np.flatnonzero(keep))
                columns = {k: pa.array([batch[k][i]] * len(at), batch[k].type) for k in keys}
                columns |= {c: batch[c][i].values.take(at) for c in ("seq_no", "t", "v")}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return work.select(*keys, "idx", "seq_no", "t", "v", "_t0", "_last", "_s", "_m").mapInArrow(finished, out_schema)
