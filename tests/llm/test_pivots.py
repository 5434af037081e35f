"""Operator 13: clusters, distances and digests against plain whole-number rounds."""

import hashlib
import math

import numpy as np
import pytest

from passband.llm import pivots

SCHEMA = "vec_id bigint, embedding array<double>, cluster string, distance string, n bigint, ids string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "c", "d", 1, "i") for i, v in rows], SCHEMA)


def brute(rows, clusters=8, rounds=10, dim=64):
    keep = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if v and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) < 2**17 for x in v)
    ]
    if not keep:
        return []
    order = sorted(keep, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in keep]
        for k in range(len(centres)):
            mine = [v for (_, v), o in zip(keep, own) if o == k]
            if mine:
                centres[k] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [nearest(v) for _, v in keep]
    total = sum(d for d, _ in last)
    return sorted(
        [
            (i, k, d, sum(e for e, j in last if j == k), total, hashlib.sha256(",".join(map(str, centres[k])).encode()).hexdigest())
            for (i, _), (d, k) in zip(keep, last)
        ],
        key=repr,
    )


def found(spark, rows, **sizes):
    return sorted(map(tuple, pivots.clustered(table(spark, rows), **sizes).collect()), key=repr)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(40)]
    rows += [(40, None), (41, []), (42, [0.0] * 63), (43, [None] + [0.0] * 63), (44, [float("nan")] * 64), (45, [float("inf")] * 64)]
    rows += [(46, [0.0] * 64), (46, [0.0] * 64), (None, [0.5] * 64), (47, [1e5] * 64), (48, [-1e5] * 64), (49, [1e30] * 64), rows[0], rows[0]]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    assert found(spark, rows) == brute(rows)


def test_ties_and_empty_clusters(spark):
    """Many equal vectors: centroids coincide, and all but the first of them stay empty."""
    rows = [(i, [float(i % 3), 1.0]) for i in range(60)] + [(100 + i, [0.5 + (i % 2), 1.0]) for i in range(20)]
    for rounds in (1, 10):
        assert found(spark, rows, dimensions=2, rounds=rounds) == brute(rows, rounds=rounds, dim=2)


def test_bounds_decide_and_never_err():
    """On vectors that lie in groups, bounds leave out most distances and change no assignment."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 64))
    points = pivots.whole(np.repeat(centres, 200, axis=0) + 0.1 * rng.normal(size=(1600, 64)))
    around = pivots.whole(centres + 0.02 * rng.normal(size=centres.shape))
    bounds = pivots.Bounds(around, pivots.whole(centres))
    own, least, taken = bounds.assigned(points, pivots.distances(points, bounds.pivots))
    full = np.stack([pivots.squares(points, c) for c in around], axis=1)
    assert (own == full.argmin(axis=1)).all() and (least == full.min(axis=1)).all()
    assert taken < 0.2 * full.size
