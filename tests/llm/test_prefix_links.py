"""Near duplicates are found to the last link: whole groups and prefix candidates against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
from cases import documents
from test_near_texts import found, groups_of

from passband.llm import prefix_links


def same_partition(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b)))


def test_no_link_is_left_out(spark):
    """Texts of 3 to 400 words with words replaced, most of them near the similarity asked for."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(300):
        text = [rng.choice(words) for _ in range(rng.choice([3, 12, 30, 100, 400]))]
        texts.append(" ".join(text))
        for share in (0.012, 0.025):
            other = list(text)
            for i in rng.sample(range(len(other)), max(1, int(share * len(other)))):
                other[i] = rng.choice(words)
            texts.append(" ".join(other))
        texts.append(" ".join(text[: -max(1, len(text) // 6)]))
    got = found(spark, [(i, t, "en") for i, t in enumerate(texts)])
    assert same_partition([got[i] for i in range(len(texts))], groups_of(texts))


@pytest.mark.parametrize("crowded, block", [(1_000, 4_096), (2, 20)])
def test_candidates(spark, crowded, block):
    """Sets of a common core and few others of their own, in one block and in many; groups known before."""

    def numbers(text):
        return np.unique(np.array((text or "").split(), "<u8"))

    rng = np.random.default_rng(5)
    sets = [{10**6}, {10**6, 5}, {10**6, 6}]
    for k in range(400):
        core = rng.choice(60, rng.integers(5, 60), replace=False) + 100 * (k % 2)
        sets.append({*core.tolist(), *rng.integers(1000, 10**6, rng.integers(0, 4)).tolist()})
    sets += [set(s) | {10**7 + k} for k, s in enumerate(sets[3:100])]
    texts = [" ".join(map(str, s)) for s in sets] + ["", None]
    docs = documents(spark, [(i, t, "en") for i, t in enumerate(texts)])
    key = {r.text: r.node for r in docs.select(prefix_links.text_key(docs["text"]).alias("node"), "text").collect()}
    node = [key[t] for t in texts]
    group = {node[i]: node[3] for i in range(3, 300, 2)}
    roots = spark.createDataFrame(list(group.items()), "node bigint, root bigint")
    got = {(r.u, r.v) for r in prefix_links.candidates(docs, numbers, roots, crowded, block).collect()}
    want = {
        (min(node[i], node[j]), max(node[i], node[j]))
        for i, j in combinations(range(len(sets)), 2)
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
        and node[i] != node[j]
        and group.get(node[i], node[i]) != group.get(node[j], node[j])
    }
    assert len(want) > 50 and want <= got
    assert all(u < v and group.get(u, u) != group.get(v, v) for u, v in got)


def test_one_known_group_is_not_compared(spark):
    """Copies of one group that share all their hashes give no candidates, however many they are."""

    def numbers(text):
        return np.unique(np.array(text.split(), "<u8"))

    texts = [" ".join(map(str, [*range(20), 100 + k])) for k in range(300)]
    docs = documents(spark, [(i, t, "en") for i, t in enumerate(texts)])
    nodes = [r.node for r in docs.select(prefix_links.text_key(docs["text"]).alias("node")).collect()]
    roots = spark.createDataFrame([(n, min(nodes)) for n in nodes], "node bigint, root bigint")
    assert prefix_links.candidates(docs, numbers, roots, 2, 20).count() == 0


def test_bitmaps_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(6)
    for n in (1, 3, 40, 500, 40_000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype("<u8"))
        for share in (0.01, 0.1, 1.0):
            b = np.unique(np.concatenate([a[rng.random(len(a)) > share], rng.integers(0, 1 << 63, 1 + int(share * n)).astype("<u8")]))
            bits = prefix_links.differing(prefix_links.parities(a), prefix_links.parities(b))
            assert bits <= len(np.setxor1d(a, b)) and prefix_links.differing(*[prefix_links.parities(b)] * 2) == 0
