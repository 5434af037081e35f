"""The near-duplicate stage: groups against exact Jaccard over all pairs, recall on planted pairs."""

import random
import re

import numpy as np
import pytest
from cases import ODD, documents

from passband.llm import near_texts


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a, b):
    return (not a and not b) or len(a & b) >= 0.8 * len(a | b)


def groups_of(texts):
    """Per text the first of its group, by comparing all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    holders: dict = {}
    for i, s in enumerate(sets):
        for j in {j for x in s or [()] for j in holders.get(x, ())}:
            if similar(s, sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
        for x in s or [()]:
            holders.setdefault(x, []).append(i)
    return root


def found(spark, rows):
    return {r.doc_id: r.root for r in near_texts.near_duplicates(documents(spark, rows)).collect()}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    want = groups_of([r.text for r in rows])
    got = {r.doc_id: r.root for r in near_texts.near_duplicates(docs).collect()}
    mine: dict = {}
    for r, w in zip(rows, want):
        mine.setdefault(got[r.doc_id], set()).add(w)
    assert all(len(w) == 1 for w in mine.values())  # no group holds texts that are not linked
    assert len(mine) - len(set(want)) <= 0.1 * (len(rows) - len(set(want)))


def test_recall_on_planted_pairs(spark):
    """Words replaced at random: pairs of 0.8 to 0.9 are found nearly all, none below 0.8."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows, close = [], []
    for k in range(300):
        text = [rng.choice(words) for _ in range(rng.randint(100, 400))]
        other = list(text)
        for i in rng.sample(range(len(other)), max(1, int(rng.uniform(0.005, 0.035) * len(other)))):
            other[i] = rng.choice(words)
        rows += [(2 * k, " ".join(text), "en"), (2 * k + 1, " ".join(other), "en")]
        if similar(shingles(rows[-1][1]), shingles(rows[-2][1])):
            close.append(k)
    got = found(spark, rows)
    hit = {k for k in range(300) if got[2 * k] == got[2 * k + 1]}
    assert len(close) > 150 and hit <= set(close)
    assert len(hit) >= 0.9 * len(close)


def test_odd_rows(spark):
    rows = near_texts.near_duplicates(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r.root for r in rows if r.doc_id is not None}
    assert by[1] == by[2] == by[3] and len(set(by.values())) == 6
    kept = near_texts.one_of_each(documents(spark, ODD)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 5, 6, 7, 8] and len(kept) == 7
    assert near_texts.one_of_each(documents(spark, [])).count() == 0


def test_crowded_keys(spark):
    """Many near copies of one text over several blocks are one group."""
    base = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join([*base[:200], f"x{i}", *base[201:]]), "en") for i in range(700)]
    rows += [(1000 + i, " ".join(f"other{i}-{k}" for k in range(50)), "en") for i in range(20)]
    nodes = spark.createDataFrame([(i, near_texts.fingerprint(t)) for i, t, _ in rows], "node bigint, fp binary")
    for block in (64, 512):
        root = np.arange(2000)
        for u, v in map(tuple, near_texts.candidates(nodes, block).distinct().collect()):
            low, high = sorted((root[u], root[v]))
            root[root == high] = low
        assert len(set(root[:700])) == 1 and len(set(root[1000:1020])) == 20


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_tree(n):
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 1 << 20, (n, near_texts.WORDS)).astype(np.uint64)
    i, j = near_texts.tree(fps)
    full = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    root = list(range(n))
    for a, b in zip(*np.nonzero(full <= near_texts.RADIUS)):
        root = [root[a] if r == root[b] else r for r in root]
    assert len(i) == n - len(set(root)) and (full[i, j] <= near_texts.RADIUS).all()
