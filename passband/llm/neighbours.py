"""Nearest neighbours by collision counting over query-centred windows (operator 5).

Vectors are packed into blocks.  Within a block every one of ``PROJECTIONS`` random directions keeps
its projections in one sorted array.  A query opens a window around its own projection in each array
and widens all of them step by step (virtual rehashing: the arrays stay as they are).  A vector that
lies in the windows of at least ``THRESHOLD`` of the directions is a candidate; once enough of a
block are candidates, their true distances are computed.  Candidates of all blocks are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS, THRESHOLD = 192, 96
#: First half-width of a window in standard deviations of a block's projections, and its growth.
WINDOW, GROWTH = 0.4, 1.1
#: The widening of a query ends when, besides the neighbours wanted, so many times the root of a
#: block's rows collide often enough: some 400 of 2000 rows, a sixteenth of 16 384.
ROOM = 8
BLOCK_ROWS, QUERY_ROWS = 16_384, 256
#: Shards that blocks of vectors are dealt to, and so copies of every block of queries that move.
SHARDS = 64
SEED = 20


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, PROJECTIONS))


class Index:
    """The sorted projections of one block of vectors (rows of doubles)."""

    def __init__(self, vectors: np.ndarray):
        self.axes = directions(vectors.shape[1])
        projected = vectors @ self.axes
        order = np.argsort(projected, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(projected, order, 0).T)
        self.order = np.ascontiguousarray(order.T.astype(np.int32))
        self.n = len(vectors)
        spread = float(projected.std(axis=0).mean())
        self.start = WINDOW * spread if spread > 0 else 1.0

    def enough(self, wanted: int) -> int:
        return min(self.n, wanted + int(ROOM * self.n**0.5))

    def candidates(self, queries: np.ndarray, wanted: int) -> list[np.ndarray]:
        """Per query the rows that collide with it in enough directions."""
        enough, centres = self.enough(wanted), queries @ self.axes
        hits = np.zeros((len(queries), self.n), np.int16)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
        open_ = np.arange(len(queries))
        left = right = np.zeros((len(queries), PROJECTIONS), np.int64)
        half, first = self.start, True
        while len(open_):
            low, high = left.copy(), right.copy()
            for p, s in enumerate(self.sorted):
                low[open_, p] = s.searchsorted(centres[open_, p] - half)
                high[open_, p] = s.searchsorted(centres[open_, p] + half, "right")
            done = []
            for q in open_.tolist():
                if first:
                    fresh = [o[a:b] for o, a, b in zip(self.order, low[q].tolist(), high[q].tolist())]
                else:  # only what the wider windows add
                    fresh = [o[a:b] for o, a, b in zip(self.order, low[q].tolist(), left[q].tolist())]
                    fresh += [o[a:b] for o, a, b in zip(self.order, right[q].tolist(), high[q].tolist())]
                hits[q] += np.bincount(np.concatenate(fresh), minlength=self.n).astype(np.int16)
                found = np.flatnonzero(hits[q] >= THRESHOLD)
                if len(found) >= enough:
                    out[q] = found
                    done.append(q)
            open_ = np.setdiff1d(open_, done)
            left, right, first = low, high, False
            half *= GROWTH
        return out


def usable(df: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part.

    Left out are rows with a null vec_id and vectors that are null, empty, all zero, or hold a null
    or a component that is not finite.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        df.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
        .filter(F.col("vec_id").isNotNull() & x.isNotNull())
        .filter(~bad & F.exists(x, lambda v: v != 0))
    )


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """dim, ids, vectors: blocks of up to ``rows`` vectors of one length as raw bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, flat = zip(*held.pop(dim))
            count.pop(dim)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([dim], pa.int32()),
                    pa.array([np.concatenate(ids).tobytes()]),
                    pa.array([np.concatenate(flat).tobytes()]),
                ],
                names=["dim", "ids", "vectors"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part["embedding"]
                sizes = pa.compute.list_value_length(lists).to_numpy()
                flat = lists.flatten().to_numpy()
                starts = np.cumsum(sizes) - sizes
                ids = part["vec_id"].to_numpy()
                for dim in np.unique(sizes).tolist():
                    mine = np.flatnonzero(sizes == dim)
                    values = flat[(starts[mine][:, None] + np.arange(dim)).ravel()]
                    held.setdefault(dim, []).append((ids[mine], values))
                    count[dim] = count.get(dim, 0) + len(mine)
                    if count[dim] >= rows:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return df.select("vec_id", "embedding").mapInArrow(run, "dim int, ids binary, vectors binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest vectors found for each query.

    The score is the Euclidean distance of the original vectors in double precision; ties go to the
    smaller vec_id.  Only vectors of the query's length are compared, and those with its own vec_id
    are not.  A vec_id that is there twice among ``queries`` is asked with the lesser vector; rows
    there twice among ``vectors`` are candidates each.  Blocks of queries meet blocks of vectors:
    what is joined are blocks, and each pair of blocks leaves ``k`` rows per query.
    """
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asks = _packed(asked, QUERY_ROWS).select(
        "dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = None, None
        for batch in batches:
            columns = [batch[c] for c in ("dim", "ids", "vectors", "query_ids", "query_vectors")]
            for dim, ids, raw, query_ids, query_raw in zip(*columns):
                dim, raw = dim.as_py(), raw.as_py()
                if raw != known:
                    known, rows = raw, np.frombuffer(raw, "<f8").reshape(-1, dim)
                    index = Index(rows)
                ids = np.frombuffer(ids.as_py(), "<i8")
                query_ids = np.frombuffer(query_ids.as_py(), "<i8")
                points = np.frombuffer(query_raw.as_py(), "<f8").reshape(-1, dim)
                out = []
                # one more is wanted for each row that may be the query itself
                for q, point, found in zip(query_ids.tolist(), points, index.candidates(points, k + 1)):
                    found = found[ids[found] != q]
                    distance = np.sqrt(np.square(rows[found] - point).sum(axis=1))
                    best = np.lexsort((ids[found], distance))[:k]
                    out.append((np.full(len(best), q), ids[found][best], distance[best]))
                q, v, s = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"]
                )

    # Every block of vectors meets every block of queries of its length: the smaller side, a stated
    # share of the rows, is dealt to all shards of the larger one.  Spark takes the copies for a table
    # as small as the queries and would broadcast them through the driver, hence the hint.  Both sides
    # are dealt out by number: searches take long over few octets, and tasks are not to be merged.
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = min(parts, SHARDS)
    blocks = (
        _packed(usable(vectors), BLOCK_ROWS)
        .withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int"))
        .repartition(parts, "dim", "shard")
    )
    dealt = asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(
        parts, "dim", "shard"
    )
    found = (
        blocks.hint("merge")
        .join(dealt, ["dim", "shard"])
        .select("dim", "ids", "vectors", "query_ids", "query_vectors")
        .mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
