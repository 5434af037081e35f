"""Operator 7: the sharded model against a dictionary version of the same formulas."""

import math
from collections import Counter

import pytest
from cases import ODD, documents

from passband.llm import perplexity, queries


def symbols(text):
    return [0x110000, 0x110000, *map(ord, text or ""), 0x110001]


def grams(text):
    s = symbols(text)
    return list(zip(s, s[1:], s[2:]))


def discounts(counts):
    n = Counter(v for v in counts.values() if v <= 4)
    if not n[1] or not n[2]:
        return 0.5, 0.5, 0.5
    y = n[1] / (n[1] + 2 * n[2])
    found = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 2.0)
    return tuple(min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1))


class Brute:
    def __init__(self, texts):
        tri = Counter(g for t in texts for g in grams(t))
        bi = Counter(g[1:] for g in tri)
        uni = Counter(g[1:] for g in bi)
        self.levels = [(c, discounts(c)) for c in (uni, bi, tri)]
        self.sums = []
        for c, d in self.levels:
            total, left = Counter(), Counter()
            for g, n in c.items():
                total[g[:-1]] += n
                left[g[:-1]] += d[min(n, 3) - 1]
            self.sums.append((total, left))
        self.size = len(uni) + 1

    def p(self, gram):
        if not gram:
            return 1 / self.size
        counts, d = self.levels[len(gram) - 1]
        total, left = self.sums[len(gram) - 1]
        if not total[gram[:-1]]:
            return self.p(gram[1:])
        n = counts[gram]
        share = (n - d[min(n, 3) - 1]) / total[gram[:-1]] if n else 0.0
        return share + left[gram[:-1]] / total[gram[:-1]] * self.p(gram[1:])

    def perplexity(self, text):
        gs = grams(text)
        return 2 ** (-sum(math.log2(self.p(g)) for g in gs) / len(gs))


def check(spark, docs, labels, monkeypatch=None):
    good = {}
    for i, quality, toxic in labels:
        if i is None:  # a label of no document
            continue
        good[i] = good.get(i, True) and quality == 1 and not toxic
    model = Brute([t for i, t, _ in docs if good.get(i)])
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = perplexity.scored(documents(spark, docs), table).collect()
    assert len(found) == len(docs)
    want = sorted((str(i), len(t or "") + 1, model.perplexity(t)) for i, t, _ in docs)
    got = sorted((str(r.doc_id), r["size"], r.perplexity) for r in found)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)
    assert sorted(str(r.doc_id) for r in found if r.trusted) == sorted(str(i) for i, _, _ in docs if good.get(i))


def test_against_dictionaries(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    monkeypatch.setattr(perplexity, "ROWS", 64)  # several blocks
    check(spark, docs[:120], labels)


def test_odd_rows(spark):
    labels = [(5, 1, 0), (6, 1, None), (7, 1, 0), (7, 0, 0), (8, None, 0), (None, 1, 0), (99, 1, 0)]
    check(spark, ODD, labels)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    kept = perplexity.judged(perplexity.scored(documents(spark, ODD), table)).collect()
    assert len(kept) == len(ODD)
    assert perplexity.judged(perplexity.scored(documents(spark, []), table)).count() == 0


def test_no_trust(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = perplexity.judged(perplexity.scored(documents(spark, ODD), none)).collect()
    assert len(rows) == len(ODD) and all(r.kept for r in rows)


def test_limits_are_exact_quantiles(spark):
    values = [(lang, 2 + i / 100, True) for lang, n in (("a", 101), ("b", 31), (None, 5)) for i in range(n)]
    df = spark.createDataFrame([(v[0], 2.0 ** v[1], v[2]) for v in values], "lang string, perplexity double, trusted boolean")
    got = {r.lang: r for r in perplexity.limits(df).collect()}
    for lang in ("a", "b", None):
        steps = sorted(math.floor(math.log2(2.0**x) * perplexity.STEPS) for l, x, _ in values if lang is None or l == lang)
        at = lambda q: steps[math.ceil(q * len(steps)) - 1]
        assert got[lang].median == pytest.approx(at(0.5) / perplexity.STEPS)
        want = at(0.5) + perplexity.REACH * (at(perplexity.QUANTILE) - at(0.5)) + 1
        assert got[lang].limit == pytest.approx(want / perplexity.STEPS)


def test_whole_query(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op7_quality_perplexity(spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    good = [got[i].kept for i, l in labels.items() if l.quality == 1 and not l.toxic]
    bad = [got[i].kept for i, l in labels.items() if l.quality == 0]
    assert sum(good) / len(good) >= 0.99 and sum(bad) / len(bad) <= 0.5
