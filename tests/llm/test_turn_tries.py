"""Operator 12: nodes against a trie of whole turns built in one place, for every size of container."""

import hashlib
import math
import zlib

import pytest

from passband.llm import turn_tries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, depth int, n bigint, head string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, "h") for r in rows], SCHEMA)


def brute(rows):
    own: dict[int, list] = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    members: dict[tuple, list] = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = (*own.get(c - int(math.fmod(c, 5)), [])[:h], *turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, d == len(path)))
    kids: dict[tuple, list] = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(c for c, e in members[p] if e))
        least = lambda q: min(c for c, _ in members[q])
        out.append(
            (least(p), len(p), least(p[:-1]) if p else None, len(members[p]), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=repr)


def found(spark, rows, *sizes):
    return sorted(map(tuple, turn_tries.prefix_trie(table(spark, rows), *sizes).collect()), key=repr)


ODD = [
    (1, 0, "user", "a"), (1, 1, None, "b"), (1, None, "system", None), (2, 0, "user", "a"), (2, 1, "", "b"), (3, 0, "user", ""),
    (None, 0, "user", "a"), (4, 5, "us", "era"), (4, 6, "use", "ra"), (5, 0, "user", "a"), (5, 0, "user", "a"), (6, 0, "user", "é😀" * 3000),
    (0, 0, "user", "hello"), (0, 1, "assistant", "yes"), (10, 0, "user", "hello"), (10, 1, "assistant", "yes"), (10, 2, "user", "more"),
    (11, 7, "user", "own"), (12, 0, None, None), (-5, 0, "user", "hello"), (-7, 0, "user", "hello"), (1 << 40, 0, "user", "hello"),
]


@pytest.mark.parametrize("sizes", [(1, 1), (2, 3), (1024, 8)])
def test_odd_rows(spark, sizes):
    assert found(spark, ODD, *sizes) == brute(ODD)


def test_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


@pytest.mark.parametrize("sizes", [(3, 2), (16, 4), (1024, 8)])
def test_shared_and_deep_paths(spark, sizes):
    """A long start that many share, a comb of ever longer ones, and many copies of one."""
    rows = []
    for c in range(60):
        rows += [(c, t, "user", f"t{t}") for t in range(40)] + [(c, 40 + t, "user", f"{c % 7}-{t}") for t in range(c % 4)]
    for c in range(100, 130):
        rows += [(c, t, "user", f"comb {t}") for t in range(c - 99)]
    for c in range(200, 300):
        rows += [(c, t, "user", f"same {t}") for t in range(12)]
    assert found(spark, rows, *sizes) == brute(rows)


def test_common_turns():
    a = b"x" * 24 + b"y" * 24 + b"z" * 24
    assert [turn_tries.common_turns(a, b) for b in (a, a[:48], b"", b"x" * 24 + b"q" * 48)] == [3, 2, 0, 1]
