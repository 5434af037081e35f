"""Centroid clustering in whole numbers, with Ptolemaic lower bounds (operator 13).

For any four points Ptolemy's inequality gives

    d(x, c) * d(p, q) >= |d(x, p) * d(c, q) - d(x, q) * d(c, p)|

so distances to fixed pivots p and q, kept beside each vector, bound its distance to a centroid c from
below without reading the vector.  The pivots are the centroids of an early round, one for each, and
every centroid is bounded by the pairs that its own pivot forms with the others: near its pivot the
bound is near the distance itself.  Bounds are rounded down and compared with a squared distance
rounded up, so a centroid is only left out if it is farther for certain.  All others are checked in
64-bit whole numbers, and ties go to the smaller number.

Vectors lie in blocks, in a stored table.  A round sends out the few centroids and gets back sums per
cluster and component, added up by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.llm.common import small, stored

CLUSTERS, DIMENSIONS, ROUNDS, SCALE, SEED = 8, 64, 10, 1024, 3
#: Rounds after which the pivots are taken anew, from centroids that have found their places.
SETTLED = 2
#: Vectors of a block.
ROWS = 4096
#: Components from which squared distances need not fit a long.
MOST = 2.0**17
#: Relative slack of bounds, far above the rounding of their few operations.
SLACK = 2.0**-44

BLOCK = "ids array<bigint>, vectors binary, pivots binary"


def usable(df: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part.

    Left out are vectors of another length, those that are null or hold a null or a component that
    is not finite, and those with a component of ``MOST`` or more in size, whose distances need not
    fit a long.  Rows with a null vec_id take part; repeated rows take part each.
    """
    x = F.col("embedding")
    fits = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < MOST))
    rows = df.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    return rows.filter((F.size(x) == dimensions) & fits)


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(values * SCALE).astype(np.int64)


def first_centroids(vectors: DataFrame, clusters: int) -> np.ndarray:
    """The vectors with the smallest hashes of their vec_id; ties go to the smaller vector."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    drawn = vectors.select(digest.alias("digest"), "embedding")
    rows = drawn.orderBy(F.col("digest").asc_nulls_last(), "embedding").limit(clusters).collect()
    return whole(np.array([r.embedding for r in rows]))


class Bounds(NamedTuple):
    """What a round needs to know besides the blocks: centroids, pivots and the distances between."""

    centroids: np.ndarray
    pivots: np.ndarray

    def assigned(self, vectors: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of every vector, and how many distances it took."""
        n, k = len(vectors), len(self.centroids)
        across = distances(self.centroids, self.pivots)
        between = distances(self.pivots, self.pivots)
        best = cached.argmin(axis=1)
        least = squares(vectors, self.centroids[best])
        taken = n
        for c in range(k):
            limit = least * (1 + SLACK)
            bound = np.zeros(n)
            for q in range(len(self.pivots)):
                if between[c, q] > 0:
                    one, two = cached[:, c] * across[c, q], cached[:, q] * across[c, c]
                    np.maximum(bound, (np.abs(one - two) - SLACK * (one + two)) / between[c, q], out=bound)
            open_ = np.flatnonzero((np.square(bound) * (1 - SLACK) <= limit) & (best != c))
            if len(open_):
                found = squares(vectors[open_], self.centroids[c])
                nearer = (found < least[open_]) | ((found == least[open_]) & (c < best[open_]))
                best[open_[nearer]], least[open_[nearer]] = c, found[nearer]
                taken += len(open_)
        return best, least, taken


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    difference = a - b
    return np.einsum("ij,ij->i", difference, difference)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rounded distances of all rows of ``a`` to the few of ``b``, from exact squares."""
    return np.sqrt(np.stack([squares(a, row) for row in b], axis=1).astype(float))


def _unpacked(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[pa.Array, np.ndarray, bytes]]:
    for ids, raw, cached in zip(*(batch[c] for c in ("ids", "vectors", "pivots"))):
        yield ids.values, np.frombuffer(raw.as_py(), "<i4").reshape(-1, dimensions).astype(np.int64), cached.as_py()


def _block(ids: pa.Array, vectors: np.ndarray, pivots: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    raw = [pa.array([x.tobytes()], pa.binary()) for x in (vectors.astype("<i4"), distances(vectors, pivots))]
    return pa.RecordBatch.from_arrays([lists, *raw], names=["ids", "vectors", "pivots"])


def packed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Blocks of vectors in whole numbers, with their distances to the pivots."""
    dimensions = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values = part["embedding"].flatten().to_numpy().reshape(-1, dimensions)
                yield _block(part["vec_id"], whole(values), pivots)

    return vectors.select("vec_id", "embedding").mapInArrow(run, BLOCK)


def repivoted(blocks: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``blocks`` with distances to other pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, _ in _unpacked(batch, pivots.shape[1]):
                yield _block(ids, vectors, pivots)

    return blocks.mapInArrow(run, BLOCK)


def moved(blocks: DataFrame, bounds: Bounds) -> np.ndarray:
    """The centroids after one round: floored means of the vectors nearest to each.

    Tasks send sums per cluster; Spark adds them up, and the driver gets one row per component.
    """
    clusters, dimensions = bounds.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((clusters, dimensions), np.int64), np.zeros(clusters, np.int64)
        for batch in batches:
            for _, vectors, cached in _unpacked(batch, dimensions):
                own, _, _ = bounds.assigned(vectors, np.frombuffer(cached).reshape(len(vectors), -1))
                count += np.bincount(own, minlength=clusters)
                for c in range(clusters):
                    sums[c] += vectors[own == c].sum(axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(count[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    parts = blocks.mapInArrow(run, "cluster bigint, n bigint, sums array<bigint>")
    rows = (
        parts.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
        .groupBy("cluster", "at")
        .agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        .collect()
    )
    out = bounds.centroids.copy()
    for r in rows:
        out[r.cluster, r["at"]] = int(r.total) // r.n
    return out


def clustered(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector.

    Rows that :func:`usable` leaves out have no row here.  With fewer vectors than clusters every
    vector starts a centroid; with none there are no rows.  Equal centroids are told apart by
    number, and those without vectors stay where they are.  A sum that does not fit a long is null.
    """
    spark = df.sparkSession
    vectors = usable(df, dimensions)
    centroids = first_centroids(vectors, clusters)
    if not len(centroids):
        return spark.createDataFrame([], _RESULT)
    pivots = centroids
    blocks = stored(packed(vectors, pivots))
    for k in range(rounds):
        if k == SETTLED:
            pivots = centroids
            blocks = stored(repivoted(blocks, pivots))
        centroids = moved(blocks, Bounds(centroids, pivots))
    bounds = Bounds(centroids, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, cached in _unpacked(batch, dimensions):
                own, least, _ = bounds.assigned(vectors, np.frombuffer(cached).reshape(len(vectors), -1))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(own.astype(np.int32)), pa.array(least)], names=["vec_id", "cluster", "distance"]
                )

    found = stored(blocks.mapInArrow(run, "vec_id bigint, cluster int, distance bigint"))
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(total.alias("total")).collect()}
    fit = lambda n: n if n < 1 << 63 else None
    facts = [
        (c, fit(n), fit(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, n in sums.items()
    ]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(small(known, 128), "cluster").select("vec_id", "cluster", "distance", *known.columns[1:])


_RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def sql(table: str = "embeddings") -> str:
    """The same clustering as SQL, its rounds written out one by one."""
    kept = (
        f"len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR abs(x::DOUBLE) >= {int(MOST)})) = 0"
    )
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS x FROM {table} WHERE {kept})",
        f"s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS k, x FROM v ORDER BY ALL LIMIT {CLUSTERS})",
        f"i AS MATERIALIZED (SELECT vec_id, unnest(x) AS x, unnest(range({DIMENSIONS})) AS p FROM v)",
        f"c0 AS MATERIALIZED (SELECT k, unnest(x) AS x, unnest(range({DIMENSIONS})) AS p FROM s)",
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"""d{r} AS MATERIALIZED (SELECT vec_id, k, sum((i.x - c.x) * (i.x - c.x)) AS d FROM i JOIN c{r} c USING (p) GROUP BY ALL)"""
        )
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)"""
        )
        if r < ROUNDS:
            parts.append(
                f"""m{r} AS MATERIALIZED (SELECT k, p, sum(x)::HUGEINT AS t, count(*)::HUGEINT AS n FROM i JOIN a{r} USING (vec_id) GROUP BY ALL)"""
            )
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT k, p, coalesce((t - ((t % n + n) % n)) // n, x) AS x FROM c{r} LEFT JOIN m{r} USING (k, p))"""
            )
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       h AS centroid_sha256
FROM a{ROUNDS} JOIN (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS h FROM c{ROUNDS} GROUP BY k) USING (k)"""
    )
