"""What the latest value, the update count and the bounded history of a parameter are."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passband.functions.predicates import contains_ascii_fold
from passband.operators.lookup import dimension
from passband.operators.ordered import DEFAULT_WIDTH, carry, newest
from passband.session import pin

UPDATE_CEILING = 4_294_967_295
MAX_MATCHES = 512
DEFAULT_DEPTH = 4096


#: More than any position in a packet; a packet number times this still fits 38 digits.
POSITIONS = Decimal(10**19)


def arrival(packet: str = "pkt_no", ordinal: str = "ordinal") -> Column:
    """Packet, then position in it: the order of arrival, for any number of either.

    One decimal and no struct: aggregations keep it in their hash table and need not sort.
    """
    return F.col(packet).cast("decimal(19,0)") * F.lit(POSITIONS) + F.col(ordinal).cast("decimal(19,0)")


def latest(
    samples: DataFrame,
    columns: Sequence[str] = ("received", "raw", "eng"),
    keys: Sequence[str] = ("parameter",),
) -> DataFrame:
    """Latest sample per parameter by arrival, with its update count.

    One aggregation with map-side combine: a parameter that is a third of all samples still
    leaves each task as one row.
    """
    at = arrival()
    return samples.groupBy(*keys).agg(
        *[F.max_by(F.col(c), at).alias(c) for c in columns],
        F.least(F.count(F.lit(1)), F.lit(UPDATE_CEILING)).alias("updates"),
    )


def seen(samples: DataFrame) -> DataFrame:
    return samples.select("parameter").distinct()


def never_seen(definition: DataFrame, samples: DataFrame) -> DataFrame:
    """Declared parameters no packet has carried yet."""
    return definition.join(seen(samples), "parameter", "left_anti")


def watched_samples(samples: DataFrame, watch: DataFrame) -> DataFrame:
    """Only watched parameters keep points."""
    return samples.join(dimension(watch.select("parameter").distinct()), "parameter", "left_semi")


def bounded_history(
    samples: DataFrame,
    watch: DataFrame,
    depth: int = DEFAULT_DEPTH,
    *,
    order: str = "pkt_no",
    number: str = "eng",
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """The newest ``depth`` numeric points of every watched parameter."""
    points = watched_samples(samples, watch).filter(F.col(number).isNotNull())
    return newest(points, ["parameter"], order, depth, width=width)


def value_changes(
    samples: DataFrame, value: str = "eng", *, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Rows whose value differs from the parameter's previous one; NaN differs from NaN."""
    stepped = carry(
        samples,
        ["parameter"],
        "pkt_no",
        previous={"previous": value},
        sums={"_rn": F.lit(1)},
        width=width,
    )
    same = F.col(value).eqNullSafe(F.col("previous")) & ~F.coalesce(F.isnan(value), F.lit(False))
    return stepped.filter((F.col("_rn") == 1) | ~same).drop("_rn")


def resolve(names: DataFrame, definition: DataFrame, column: str = "name") -> DataFrame:
    """Match names against qualified names, then leaf names; one parameter per name.

    Two equi-joins instead of one join on an OR.  A leaf several parameters share names the
    first of them in definition order (``declared``).
    """
    qualified = definition.select(F.col("parameter").alias(column), "parameter")
    leaves = definition.groupBy(F.col("leaf").alias(column)).agg(
        F.min_by("parameter", "declared").alias("parameter")
    )
    by_leaf = leaves.join(qualified, column, "left_anti")
    return names.join(qualified.unionByName(by_leaf), column)


def orphans(names: DataFrame, definition: DataFrame, column: str = "name") -> DataFrame:
    """Kept names the definition does not declare."""
    known = definition.select(F.col("parameter").alias(column)).unionByName(
        definition.select(F.col("leaf").alias(column))
    )
    return names.join(known, column, "left_anti")


def describe(samples: DataFrame, definition: DataFrame) -> DataFrame:
    """Attach names and units; samples the definition cannot name are skipped."""
    held = dimension(
        definition.select(
            "parameter",
            F.col("leaf").alias("name"),
            F.get("units", F.lit(0)).alias("first_unit"),
            F.array_join("units", " ").alias("unit"),
        )
    )
    return samples.join(held, "parameter")


def name_search(
    definition: DataFrame,
    needle: str,
    watch: DataFrame,
    samples: DataFrame,
    limit: int = MAX_MATCHES,
) -> DataFrame:
    """First ``limit`` names containing ``needle`` in definition order, with flags and the overflow count."""
    hits = definition.filter(contains_ascii_fold(F.col("parameter"), needle))
    kept = hits.orderBy("declared").limit(limit).select("parameter", "space_system", "plottable")
    total = hits.select(F.count(F.lit(1))).scalar()
    # ``kept`` holds at most ``limit`` rows, so it can be sent to every task of the sample scan.
    last = (
        samples.join(F.broadcast(kept.select("parameter")), "parameter", "left_semi")
        .groupBy("parameter")
        .agg(F.max_by("received", arrival()).alias("last"))
    )
    flags = watch.select("parameter").distinct().withColumn("watched", F.lit(True))
    return (
        kept.join(last, "parameter", "left")
        .join(flags, "parameter", "left")
        .select(
            "parameter",
            "space_system",
            "plottable",
            F.coalesce("watched", F.lit(False)).alias("watched"),
            F.col("last").isNotNull().alias("seen"),
            "last",
            F.greatest(total - limit, F.lit(0)).alias("overflow"),
        )
    )


def with_places(rows: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """``rows`` with ``place``: from 1, their place in the order of ``keys``.

    A range-partitioned sort numbers the rows of each partition, and the partitions' counts say
    where each begins, so no task sees all rows.
    """
    row = F.monotonically_increasing_id()
    placed = pin(
        rows.orderBy(*keys)
        .withColumn("_part", F.shiftright(row, 33))
        .withColumn("_row", row.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    place = F.col("_start") + F.col("_row") + 1
    return placed.join(dimension(starts), "_part").select(*rows.columns, place.alias("place"))


def value_table(
    samples: DataFrame, needle: str = "", watch: DataFrame | None = None
) -> DataFrame:
    """Latest values of the parameters the table shows; both filters run before aggregation."""
    chosen = samples.filter(contains_ascii_fold(F.col("parameter"), needle))
    if watch is not None:
        chosen = watched_samples(chosen, watch)
    return latest(chosen)


def sort_keys(sort: str, reverse: bool = False) -> list[Column]:
    """Name ascending, or time/limit/updates descending with ties by name; reversed flips all."""
    column = {"time": "received", "limit": "state", "updates": "updates"}.get(sort)
    name = F.col("parameter")
    if column is None:
        if sort != "name":
            raise ValueError(f"no such order: {sort}")
        return [name.desc() if reverse else name.asc()]
    if reverse:
        return [F.col(column).asc(), name.desc()]
    return [F.col(column).desc(), name.asc()]
