"""Near-duplicate vectors of one label by product quantisation and exact rerank (operator 11).

Unit vectors are put on the inverted list of their nearest coarse centroid.  What is left of a vector
is cut into subspaces, each coded by its nearest codeword; beside the codes lies how far the coded
vector is from the true one.  A pair is looked at in three steps, none of which loses a link:

* A partner lies within ``r = sqrt(2 - 2 * threshold)``, and nearer to its own centroid than to any
  other, so it is on a list whose border with the query's list is within ``r`` of the query.  A query
  probes all those lists, as many as there are.
* The asymmetric distance between the query and a coded vector, summed from the query's tables, is off
  by no more than the error stored with the codes.  Rows that stay beyond ``r`` by more go.
* The cosine of what is left is computed in double precision from the original vectors.

Lists are laid end to end and cut into blocks of bounded size, so a crowded list is several blocks.
Blocks meet if one probes a list of the other.  A pair of blocks leaves a count per row and a spanning
forest of its links, never the links themselves; copies are brought together before.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passband.llm.common import small, stored
from passband.llm.components import components

#: Vectors of one length that lists and codewords are fitted to, about; all vectors are indexed.
SAMPLE = 8192
SUBSPACES, WORDS = 8, 64
STEPS, SEED = 8, 11
#: Vectors of a block, and queries compared at once.
ROWS, QUERIES = 2048, 256
#: Room for rounding in bounds, far above that of their few operations on unit vectors.
SLACK = 1e-6


class Codes(NamedTuple):
    """Coarse centroids, and per subspace its first and last component and its codewords."""

    centroids: np.ndarray
    cuts: list[tuple[int, int]]
    words: list[np.ndarray]

    def listed(self, units: np.ndarray) -> np.ndarray:
        return apart(units, self.centroids).argmin(axis=1)

    def coded(self, units: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of residuals, the part of distances that depends on them alone, and their errors."""
        centre = self.centroids[own]
        rest = units - centre
        codes = np.empty((len(units), len(self.cuts)), np.uint8)
        near = np.empty_like(rest)
        for m, ((a, b), words) in enumerate(zip(self.cuts, self.words)):
            codes[:, m] = apart(rest[:, a:b], words).argmin(axis=1)
            near[:, a:b] = words[codes[:, m]]
        own_part = np.einsum("ij,ij->i", near, near + 2 * centre)
        return codes, own_part, np.linalg.norm(rest - near, axis=1)


def apart(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of points and centres."""
    cross = points @ centres.T
    return np.square(points).sum(axis=1)[:, None] - 2 * cross + np.square(centres).sum(axis=1)


def _means(points: np.ndarray, k: int) -> np.ndarray:
    """``k`` centres of points, from the first ones on."""
    centres = points[:k].copy()
    for _ in range(STEPS):
        own = apart(points, centres).argmin(axis=1)
        order = np.argsort(own, kind="stable")
        some, starts = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(points[order], starts)
        centres[some] = sums / np.diff(np.append(starts, len(points)))[:, None]
    return centres


def lists_for(rows: int) -> int:
    """Coarse lists for so many vectors; more than an eighth of the sample would not be fitted."""
    return min(max(1, math.isqrt(rows) // 4), SAMPLE // 8)


def fitted(units: np.ndarray, rows: int) -> Codes:
    centroids = _means(units, min(lists_for(rows), len(units)))
    rest = units - centroids[apart(units, centroids).argmin(axis=1)]
    edges = np.linspace(0, units.shape[1], min(SUBSPACES, units.shape[1]) + 1).astype(int).tolist()
    cuts = list(zip(edges, edges[1:]))
    return Codes(centroids, cuts, [_means(np.ascontiguousarray(rest[:, a:b]), min(WORDS, len(rest))) for a, b in cuts])


def told_apart(df: DataFrame) -> DataFrame:
    """vec_id, label, dim, key (a digest of the vector), vector (raw doubles); the last two are null
    for rows that link with nothing.

    Those are rows whose label is null, and vectors that are null, empty, all zero or hold a null or
    a component that is not finite.  Vectors are scaled by a power of two, which leaves cosines as
    they are and keeps squares in range.
    """
    x = F.col("embedding").cast("array<double>")
    good = (
        F.col("label").isNotNull()
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(x, lambda v: v != 0)
    )
    rows = df.select(
        F.col("vec_id").cast("bigint"), F.col("label").cast("string").alias("label"), F.when(good, x).alias("x")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["x"]
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
            flat, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
            keys, raw = [], []
            for n, end in zip(sizes.tolist(), ends.tolist()):
                if not n:
                    keys.append(None)
                    raw.append(None)
                    continue
                values = flat[end - n : end] + 0.0  # no negative zeros
                octets = np.ldexp(values, -int(np.frexp(np.abs(values).max())[1])).astype("<f8").tobytes()
                keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                raw.append(octets)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())],
                names=["vec_id", "label", "dim", "key", "vector"],
            )

    return rows.mapInArrow(run, "vec_id bigint, label string, dim int, key binary, vector binary")


def _units(vectors: pa.Array, dim: int) -> np.ndarray:
    points = np.frombuffer(b"".join(vectors.to_pylist()), "<f8").reshape(-1, dim)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def fit(distinct: DataFrame) -> dict[int, Codes]:
    """Codes per vector length, each fitted by one task to a sample of about ``SAMPLE`` vectors.

    A model has at most some thousand centroids; one is made for each length that occurs.
    """
    sizes = distinct.groupBy("dim").count()
    share = sizes.select("dim", "count", (F.lit(float(SAMPLE << 30)) / F.col("count")).alias("cut"))
    drawn = distinct.withColumn("draw", F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 30)))
    drawn = drawn.join(small(stored(share), 32), "dim").filter("draw < cut").select("dim", "count", "draw", "key", "vector")

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("key", "ascending")])
        dim = key[0].as_py()
        codes = fitted(_units(table["vector"], dim), table["count"][0].as_py())
        arrays = [codes.centroids, *codes.words]
        return pa.table(
            {"dim": pa.array([dim] * len(arrays), pa.int32()), "part": pa.array(range(len(arrays)), pa.int32()), "values": [a.tobytes() for a in arrays]}
        )

    found: dict[int, Codes] = {}
    rows = drawn.groupBy("dim").applyInArrow(learn, "dim int, part int, values binary").collect()
    for dim in {r.dim for r in rows}:
        first, *words = [r["values"] for r in sorted((r for r in rows if r.dim == dim), key=lambda r: r.part)]
        edges = np.linspace(0, dim, len(words) + 1).astype(int).tolist()
        cuts = list(zip(edges, edges[1:]))
        found[dim] = Codes(
            np.frombuffer(first).reshape(-1, dim), cuts, [np.frombuffer(w).reshape(-1, b - a) for w, (a, b) in zip(words, cuts)]
        )
    return found


ROW = "label string, dim int, list int, node bigint, copies bigint, vector binary, codes binary, own double, error double"
BLOCK = "label string, dim int, block bigint, lists array<int>, probes array<int>, list binary, node binary, copies binary, vector binary, codes binary, own binary, error binary"
PARTS = {"list": "<i4", "node": "<i8", "copies": "<i8", "vector": "<f8", "codes": "u1", "own": "<f8", "error": "<f8"}


def coded(distinct: DataFrame, codes: dict[int, Codes]) -> DataFrame:
    """:data:`ROW` of every distinct vector: its list, its codes and how far these are from it."""
    shipped = distinct.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                units, model = _units(part["vector"], dim), shipped.value[dim]
                own = model.listed(units)
                code, alone, error = model.coded(units, own)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["label"], part["dim"], pa.array(own.astype("i4")), part["node"], part["copies"], part["vector"],
                        pa.array([c.tobytes() for c in code], pa.binary()), pa.array(alone), pa.array(error),
                    ],
                    names=["label", "dim", "list", "node", "copies", "vector", "codes", "own", "error"],
                )

    return distinct.mapInArrow(run, ROW)


def gaps(codes: Codes) -> np.ndarray:
    """Distances between centroids."""
    return np.sqrt(np.maximum(apart(codes.centroids, codes.centroids), 0))


def reached(
    units: np.ndarray, own: np.ndarray, centroids: np.ndarray, between: np.ndarray, radius: float
) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to all centroids, and which lists may hold something within ``radius``."""
    squared = apart(units, centroids)
    nearest = squared[np.arange(len(own)), own]
    return squared, squared - nearest[:, None] <= 2 * radius * between[own] + SLACK


def blocks(rows: DataFrame, codes: dict[int, Codes], radius: float) -> DataFrame:
    """:data:`BLOCK` rows from sorted :data:`ROW` rows: up to ``ROWS`` of one label and length each."""
    shipped = rows.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        between: dict[int, np.ndarray] = {}
        of: tuple = ()

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            label, dim = of
            columns = {c: table[c].combine_chunks() for c in PARTS}
            units, own = _units(columns["vector"], dim), columns["list"].to_numpy()
            if dim not in between:
                between[dim] = gaps(shipped.value[dim])
            _, wanted = reached(units, own, shipped.value[dim].centroids, between[dim], radius)
            raw = {
                c: b"".join(x.to_pylist()) if pa.types.is_binary(x.type) else x.to_numpy().astype(PARTS[c]).tobytes()
                for c, x in columns.items()
            }
            lists = [np.unique(own).tolist(), np.flatnonzero(wanted.any(axis=0)).tolist()]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([label]), pa.array([dim], pa.int32()), columns["node"][:1],
                    *(pa.array([x], pa.list_(pa.int32())) for x in lists),
                    *(pa.array([raw[c]], pa.binary()) for c in PARTS),
                ],
                names=["label", "dim", "block", "lists", "probes", *PARTS],
            )

        for batch in batches:
            at = 0
            names = list(zip(batch["label"].to_pylist(), batch["dim"].to_pylist()))
            while at < len(names):
                if held and (names[at] != of or sum(map(len, held)) >= ROWS):
                    yield block()
                of, end = names[at], at + 1
                most = min(len(names), at + ROWS - sum(map(len, held)))
                while end < most and names[end] == of:
                    end += 1
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield block()

    return rows.mapInArrow(run, BLOCK)


class Block:
    """A block as arrays, with the rows of each of its lists."""

    def __init__(self, dim: int, **raw: bytes):
        for name, kind in PARTS.items():
            setattr(self, name, np.frombuffer(raw[name], kind))
        self.vector = self.vector.reshape(-1, dim)
        self.norm = np.linalg.norm(self.vector, axis=1)
        self.codes = self.codes.reshape(len(self.node), -1)
        some, starts = np.unique(self.list, return_index=True)
        ends = [*starts.tolist()[1:], len(self.node)]
        self.runs = list(zip(some.tolist(), starts.tolist(), ends))


def linked(a: Block, b: Block, codes: Codes, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Rows of ``a`` and of ``b`` whose cosine is ``threshold`` or more, in parts, and the cosines it took.

    With ``same`` the blocks are one, and a pair is found once.
    """
    radius, between = math.sqrt(2 - 2 * threshold), gaps(codes)
    for at in range(0, len(a.node), QUERIES):
        vector = a.vector[at : at + QUERIES]
        norm = a.norm[at : at + QUERIES]
        units = vector / norm[:, None]
        squared, wanted = reached(units, a.list[at : at + QUERIES], codes.centroids, between, radius)
        tables = [units[:, x:y] @ words.T for (x, y), words in zip(codes.cuts, codes.words)]
        for list_, start, end in b.runs:
            asks = np.flatnonzero(wanted[:, list_])
            if same:
                asks = asks[asks + at < end]
            if not len(asks):
                continue
            dots = np.zeros((len(asks), end - start))
            for m, table in enumerate(tables):
                dots += table[asks][:, b.codes[start:end, m]]
            far = np.sqrt(np.maximum(squared[asks, list_][:, None] + b.own[start:end] - 2 * dots, 0))
            i, j = np.nonzero(far - b.error[start:end] <= radius + SLACK)
            i, j = asks[i], j + start
            if same:
                i, j = i[j > i + at], j[j > i + at]
            for part in range(0, len(i), 1 << 16):
                p, q = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                cosine = np.einsum("ij,ij->i", vector[p], b.vector[q]) / (norm[p] * b.norm[q])
                ok = cosine >= threshold
                yield p[ok] + at, q[ok], len(p)


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (the smallest of its group, for each) after the groups of i and j have become one."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return root
        to = np.arange(len(root))
        np.minimum.at(to, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while True:
            further = to[to]
            if np.array_equal(further, to):
                break
            to = further
        root = to[root]


def compared(pairs: DataFrame, codes: dict[int, Codes], threshold: float) -> DataFrame:
    """node, links, root: of every row with links in a pair of blocks, how many, counting copies, and
    the root of its group there; plus pairs looked at, in rows without a node."""
    shipped = pairs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = batch.slice(row, 1).to_pylist()[0]
                dim, same = raw["dim"], raw["p"] == raw["q"]
                a = Block(dim, **{c: raw[f"p_{c}"] for c in PARTS})
                b = a if same else Block(dim, **{c: raw[f"q_{c}"] for c in PARTS})
                shift = 0 if same else len(a.node)
                nodes = a.node if same else np.concatenate([a.node, b.node])
                copies = a.copies if same else np.concatenate([a.copies, b.copies])
                links, root, taken = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), 0
                for i, j, looked in linked(a, b, shipped.value[dim], threshold, same):
                    taken += looked
                    j = j + shift
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    root = join_roots(root, i, j)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*nodes[some].tolist(), None], pa.int64()),
                        pa.array([*links[some].tolist(), taken], pa.int64()),
                        pa.array([*nodes[root[some]].tolist(), None], pa.int64()),
                    ],
                    names=["node", "links", "root"],
                )

    return pairs.mapInArrow(run, "node bigint, links bigint, root bigint")


def near_vectors(df: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``df`` (vec_id, label, embedding).

    Rows of one label link if the cosine of their vectors, in double precision, is ``threshold`` or
    more; vectors of different lengths never do.  A row that links with nothing (see
    :func:`told_apart`) stands alone.  Repeated rows count as rows each.  A null vec_id is never the
    smallest of a group; a group without any other has a null component_id, and its rows are not kept.
    """
    radius = math.sqrt(2 - 2 * threshold)
    rows = stored(told_apart(df))
    usable = rows.filter("key IS NOT NULL")
    distinct = stored(
        usable.groupBy("label", "key")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    codes = fit(distinct)
    encoded = stored(coded(distinct.select("label", "dim", "key", "node", "copies", "vector"), codes))
    spread = max(1, encoded.count() // ROWS)
    laid = encoded.repartitionByRange(spread, "label", "dim", "list", "node").sortWithinPartitions("label", "dim", "list", "node")
    cells = stored(blocks(laid, codes, radius))

    asked = cells.select("label", "dim", F.col("block").alias("p"), F.explode("probes").alias("list"))
    held = cells.select("label", "dim", F.col("block").alias("q"), F.explode("lists").alias("list"))
    met = stored(asked.join(held, ["label", "dim", "list"]).filter("p <= q").select("p", "q").distinct())
    side = lambda s: cells.select(F.col("block").alias(s), *([F.col("dim")] if s == "p" else []), *(F.col(c).alias(f"{s}_{c}") for c in PARTS))
    found = stored(compared(met.join(side("p"), "p").join(side("q"), "q"), codes, threshold)).filter("node IS NOT NULL")

    roots = components(found.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = stored(
        distinct.select("node", "label", "key", "copies", "least")
        .join(links, "node", "left")
        .join(roots.select("node", "root"), "node", "left")
        .select(
            "label", "key", "least", F.coalesce("root", "node").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = stored(member.join(named, "root").select("label", "key", "n_links", "component_id"))
    alone = rows.filter("key IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = usable.select("vec_id", "label", "key").join(small(placed, 96), ["label", "key"])
    return (
        joined.select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    )


SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), n AS MATERIALIZED (SELECT *, sqrt(list_inner_product(x, x)) AS size FROM v),
l AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / (a.size * b.size) >= 0.98
), r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.u = vec_id) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN (SELECT u, min(v) AS c FROM r GROUP BY u) ON u = vec_id
"""
