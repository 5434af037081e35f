"""Operator 5: recall, order and odd vectors against brute force."""

import math

import numpy as np
import pytest

from passband.llm import neighbours, queries


def brute(ids, points, query, k=10):
    own = points[ids == query][0]
    distance = np.sqrt(np.square(points - own).sum(axis=1))
    order = np.lexsort((ids, distance))
    return [(int(ids[i]), float(distance[i])) for i in order if ids[i] != query][:k]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_recall(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, points = table.vec_id.to_numpy(), np.array(table.embedding.tolist(), float)
    hit = total = 0
    found = queries.op5_nearest_neighbours(spark, folder).toPandas()
    asked = ids[ids % 100 == 0]
    assert sorted(found.query_id.unique()) == sorted(asked)
    for q, rows in found.groupby("query_id"):
        want = brute(ids, points, q)
        rows = rows.sort_values("rank")
        assert rows["rank"].tolist() == list(range(1, len(want) + 1))
        assert rows.score.is_monotonic_increasing
        for v, s in zip(rows.vec_id, rows.score):
            assert s == pytest.approx(math.dist(points[ids == q][0], points[ids == v][0]), abs=1e-15)
        hit += len({v for v, _ in want} & set(rows.vec_id))
        total += len(want)
    assert hit / total >= 0.9


def test_recall_within_larger_blocks(spark):
    rng = np.random.default_rng(2)
    points = rng.standard_normal((6000, 24))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    index, hit, verified = neighbours.Index(points), 0, 0
    for q, found in zip(range(0, 6000, 200), index.candidates(points[::200], 11)):
        want = np.argsort(np.square(points - points[q]).sum(axis=1))[1:11]
        hit += len(set(want) & set(found))
        verified += len(found)
    assert hit / 300 >= 0.9 and verified <= 0.25 * 30 * 6000


def test_windows_decide_at_every_size():
    """Small blocks are not verified whole either, and what is verified grows with the root of a block."""
    rng = np.random.default_rng(4)
    shares = []
    for n in (200, 1000, 5000):
        points = rng.standard_normal((n, 32))
        index = neighbours.Index(points)
        found = index.candidates(points[:20], 11)
        assert all(index.enough(11) <= len(f) < n for f in found)
        shares.append(sum(map(len, found)) / (20 * n))
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.3


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (7, [None, 1.0]), (8, [1.0, 0.1]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (100, [5.0, 5.0]), (200, None), (300, [1.0, 1.0, 1.0]),
        (11, [1.0, 0.1]), (11, [1.0, 0.1]),
    ]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score double")
    got = neighbours.nearest(df, df.filter("vec_id % 100 = 0"), 3).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {0: [1, 8, 11], 100: [1, 8, 11], 300: [9]}
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_one_common_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(9000)] + [(9000 + i, [float(i), 1.0, 0.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = neighbours.nearest(df, df.filter("vec_id in (0, 9001)"), 5).collect()
    assert sorted(r.vec_id for r in got if r.query_id == 0) == [1, 2, 3, 4, 5]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 9001][:3] == [9000, 9002, 9003]


def test_copies_of_queries_are_not_broadcast(spark):
    """Queries are as many copies as there are shards: these go to the shards and not through the driver."""
    df = spark.range(3000).selectExpr("id AS vec_id", "transform(sequence(1, 8), k -> CAST(hash(id, k) AS FLOAT)) AS embedding")
    found = neighbours.nearest(df, df.filter("vec_id % 100 = 0"), 2)
    assert found.count() == 60
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
