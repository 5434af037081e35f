"""Operator 11: links, counts and groups against brute force; nothing may be lost by lists or codes."""

import math

import numpy as np
import pytest

from passband.llm import quantised

SCHEMA = "vec_id bigint, label int, embedding array<double>, node bigint, list int, copies string, root string"


def table(spark, rows):
    return spark.createDataFrame([(i, l, v, 1, 2, "c", "r") for i, l, v in rows], SCHEMA)


def brute(rows, threshold=0.98):
    """vec_id, n_links, component_id, kept per row, by comparing all pairs."""

    def good(r):
        return r[1] is not None and r[2] and all(x is not None and math.isfinite(x) for x in r[2]) and any(r[2])

    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b))

    group, links = list(range(len(rows))), [0] * len(rows)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if good(a) and good(b) and a[1] == b[1] and len(a[2]) == len(b[2]) and cosine(a[2], b[2]) >= threshold:
                links[i] += 1
                links[j] += 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, r in enumerate(rows):
        ids = [s[0] for g, s in zip(group, rows) if g == group[i] and s[0] is not None]
        least = min(ids, default=None)
        out.append((r[0], links[i], least, r[0] is not None and r[0] == least))
    return sorted(out, key=repr)


def found(spark, rows, threshold=0.98):
    return sorted(map(tuple, quantised.near_vectors(table(spark, rows), threshold).collect()), key=repr)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, 1, [1.0, 0.0]), (4, 1, [1.0, 0.1]), (3, 2, [1.0, 0.0]), (2, None, [1.0, 0.0]), (1, 1, None), (6, 1, []), (7, 1, [0.0, 0.0]),
        (8, 1, [nan, 1.0]), (9, 1, [inf, 1.0]), (10, 1, [None, 1.0]), (11, 1, [1.0, 0.0, 0.0]), (None, 1, [2.0, 0.1]), (None, 3, [1.0, 1.0]),
        (12, 1, [1.0, 0.0]), (12, 1, [1.0, 0.0]), (13, 1, [-1.0, 0.0]), (14, 1, [-0.0, 2.0]), (15, 1, [0.0, 2.0]), (16, 4, [1e-300, 0.0]),
    ]
    assert found(spark, rows) == brute(rows)
    huge = [(1, 1, [1e308, 1e308]), (2, 1, [1e308, 1.05e308]), (3, 1, [1e-308, 1e-308])]
    assert found(spark, huge) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)]
    assert found(spark, []) == []


@pytest.mark.parametrize("threshold", [0.98, 0.9])
def test_nothing_is_lost(spark, monkeypatch, threshold):
    """Chains of vectors at all distances around the threshold, over many lists and small blocks."""
    monkeypatch.setattr(quantised, "ROWS", 64)
    monkeypatch.setattr(quantised, "QUERIES", 16)
    rng = np.random.default_rng(5)
    points = rng.standard_normal((300, 16))
    for share in np.linspace(0.05, 0.6, 12):
        some = points[rng.integers(0, 300, 25)]
        points = np.concatenate([points, some + share * rng.standard_normal(some.shape) / 4 * np.linalg.norm(some, axis=1, keepdims=True) / 4])
    rows = [(i, int(i % 3 == 0), p.tolist()) for i, p in enumerate(points)]
    got = found(spark, rows, threshold)
    assert sum(r[1] for r in got) > 50
    assert got == brute(rows, threshold)


def test_codes_leave_out_most_pairs():
    """Few pairs reach the exact step, and all that link do."""
    rng = np.random.default_rng(6)
    points = rng.standard_normal((2000, 64))
    points[1000:1100] = points[:100] + 0.1 * rng.standard_normal((100, 64))
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    codes = quantised.fitted(units, len(units))
    own = codes.listed(units)
    code, alone, error = codes.coded(units, own)
    order = np.argsort(own, kind="stable")
    columns = {"list": own, "node": np.arange(2000), "copies": np.ones(2000), "vector": points, "codes": code, "own": alone, "error": error}
    block = quantised.Block(64, **{c: v[order].astype(quantised.PARTS[c]).tobytes() for c, v in columns.items()})
    links = looked = 0
    for i, _, n in quantised.linked(block, block, codes, 0.98, True):
        links, looked = links + len(i), looked + n
    cosine = units @ units.T
    assert links == (np.triu(cosine, 1) >= 0.98).sum() >= 90
    assert looked < 0.01 * 2000 * 1999 / 2


def test_one_crowded_group(spark):
    """A third of all rows are near copies of one vector, another third exact ones."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal(32)
    near = base + 0.01 * rng.standard_normal((3000, 32))
    far = rng.standard_normal((3000, 32))
    rows = [(i, 1, p.tolist()) for i, p in enumerate([*near, *[base] * 3000, *far])]
    got = quantised.near_vectors(table(spark, rows)).toPandas().set_index("vec_id").sort_index()
    assert (got.n_links[:6000] == 5999).all() and (got.component_id[:6000] == 0).all()
    assert (got.n_links[6000:] == 0).all() and got.kept[6000:].all()
