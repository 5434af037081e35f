"""Operator 4: the code's properties, and links and groups against brute force."""

import random
from itertools import combinations

import numpy as np
import xxhash
from cases import ODD, documents

from passband.llm import golay, queries, simhash
from passband.llm.components import components


def test_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int32)[:: 1013]
    index = golay.near(words)
    assert (index[:, 0] >= 0).all() and set((index >= 0).sum(axis=1)) == {1, 6}
    rng = np.random.default_rng(0)
    some = rng.integers(0, 1 << 23, 3000)
    near = golay.near(some)
    for bit in range(23):
        other = golay.near(some ^ (1 << bit))
        assert (near == other[:, :1]).any(axis=1).all()


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in (None, "", " \n", "one", "One two", "a b c", "a b c a b c a b c", "É é\x85x A\tb\vC", "w " * 500 + "end of it"):
        assert simhash.fingerprint(text) == brute_fingerprint(text), text


def grouped(fps):
    """Smallest index within each component of fingerprints at most three bits apart."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_keys_meet_for_every_three_bits():
    rng = random.Random(9)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << b
        key, row, side = simhash.keys(np.array([x, y], np.uint64))
        written = {k for k, r, s in zip(key.tolist(), row, side) if r == 0 and s == 0}
        looked = {k for k, r, s in zip(key.tolist(), row, side) if r == 1 and s == 1}
        assert written & looked


def test_links_keep_components(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {0}
    for c in centres:  # clouds around centres, and a chain of single steps
        fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(25)}
    x = centres[0]
    for b in range(0, 60, 3):
        x ^= 7 << b
        fps.add(x)
    dense = centres[1] & ~0xFFF  # a crowded ball: many share one key
    fps |= {dense | rng.getrandbits(12) for _ in range(600)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    links = simhash.links(df)
    assert links.count() < 12 * 80 * len(fps)
    got = {r.node: r.root for r in components(links).collect()}
    want = grouped(fps)
    classes = {}
    for f, w in zip(signed, want):
        classes.setdefault(w, set()).add(got.get(f, f))
    assert all(len(c) == 1 for c in classes.values())
    assert len({min(c) for c in classes.values()}) == len(classes)


def test_bucket_links_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "CELLS", 50)
    rng = np.random.default_rng(1)
    written = np.unique(rng.integers(0, 1 << 9, 60).astype(np.uint64))
    pairs = [p for block in simhash.bucket_links(written, written) for p in zip(block[0].tolist(), block[1].tolist())]
    assert len(pairs) <= 2 * len(written)
    root = {int(w): int(w) for w in written}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in pairs:
        root[find(u)] = find(v)
    want = grouped([int(w) for w in written])
    assert len({find(int(w)) for w in written}) == len(set(want))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)], "u bigint, v bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert components(edges.limit(0)).count() == 0


def test_odd_rows(spark):
    rows = simhash.near_duplicates(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    empty = {r.component_id for r in rows if r.fp == 0}
    assert empty == {1}
    assert {r.component_id for r in rows if r.doc_id == 6} == {6}
    alone = simhash.near_duplicates(documents(spark, [(None, "no number at all here", "en")])).collect()
    assert [r.component_id for r in alone] == [None]
    assert simhash.near_duplicates(documents(spark, ODD).limit(0)).count() == 0


def test_one_of_each(spark):
    docs = documents(spark, [*ODD, (9, "a plain short text of some words", "en"), (None, "twice without", "en"), (None, "twice without", "en")])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:20]) for r in kept.collect())
    assert got == [
        (False, 1, ""), (False, 4, "12 34 !?"), (False, 5, LONG_START), (False, 6, "a plain short text o"), (False, 7, "line one\nline one\nli"),
        (False, 8, "x" * 20), (True, 0, "a row without a numb"), (True, 0, "twice without"),
    ]


LONG_START = "the quick brown fox "


def test_whole_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    fps = [brute_fingerprint(d.text) for d in docs]
    want = grouped(fps)
    got = {r.doc_id: r for r in queries.op4_simhash_duplicates(spark, folder).collect()}
    for d, f, w in zip(docs, fps, want):
        assert got[d.doc_id].fingerprint == f"{f:016x}" and got[d.doc_id].component_id == docs[w].doc_id
