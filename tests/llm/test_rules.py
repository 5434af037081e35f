"""Operator 9: features against plain counting, verdicts on plain cases."""

import base64
import math
import random
from collections import Counter

from cases import ODD, documents

from passband.llm import queries, rules


def plain(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = set()
    for i in range(len(words) - 4):
        if runs[tuple(words[i : i + 5])] > 1:
            again.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    n = len(words)
    failed = n < 10 or 100 * len(again) > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed


def features(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_repeats():
    rng = random.Random(0)
    for _ in range(1500):
        text = " ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 40)))
        assert rules.judge(text)[:6] == plain(text), text
    for text in ("a\x85b\x1cc d", "é\xa0ü x", "a\r\nb\na\r", "\n\n", "x\n\nx\n \nx"):
        assert rules.judge(text)[:6] == plain(text), text


def test_odd_rows(spark):
    rows = rules.judged(documents(spark, ODD)).collect()
    assert Counter((r.doc_id, *features(r)) for r in rows) == Counter((i, *plain(t)) for i, t, _ in ODD)
    assert not any(r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert rules.judged(documents(spark, [])).count() == 0


def test_bands():
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(900))
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(12)) for _ in range(900))
    # no five words repeat, yet the text is little but one line
    rote = "\n".join(f"item {i} of the usual list of things that we keep is number {i}" for i in range(300))
    assert rules.judge(prose)[6]
    assert not rules.judge(noise)[5] and not rules.judge(noise)[6]
    assert not rules.judge(rote)[6]


def test_encoded_noise_and_half_noise():
    rng = random.Random(2)
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    lexicon = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(1500)]
    prose = lambda n: " ".join(rng.choice(lexicon) for _ in range(n // 5))[:n]
    encoded = lambda n: base64.encodebytes(rng.randbytes(n)).decode()
    for n in (700, 1000, 3000, 6000, 60_000):
        text = encoded(n)
        assert not rules.judge(text)[5] and not rules.judge(text)[6], n
    for n in (400, 700, 1500, 4096, 16_384, 81_920):
        assert rules.judge(prose(n))[6], n
    other = [chr(c) for c in rng.sample(range(0x4E00, 0x9FA5), 2500)]  # characters as frequent as one over their rank
    for n in (100, 400, 700, 3000):
        text = "".join(rng.choices(other, [1 / (k + 10) for k in range(len(other))], k=n))
        assert rules.judge(" ".join(text[i : i + 8] for i in range(0, n, 8)))[6], n
    noisy, stale = lambda: encoded(4096)[:4096], "".join(f"the same line, number {i}\n" for i in range(170))[:4096]
    assert len(stale) == 4096
    assert not rules.judge("".join(prose(4096) + noisy() for _ in range(10)))[6]
    assert not rules.judge("".join(prose(4096) for _ in range(16)) + noisy() + noisy())[6]
    assert rules.judge("".join(prose(4096) for _ in range(8)) + noisy())[6]
    assert not rules.judge("".join(prose(4096) + stale for _ in range(2)) + prose(4096))[6]


def test_whole_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op9_compression_rules(spark, folder).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert features(r) == plain(texts[i])
        assert not (r.kept and r.base_failed)


def test_limits_of_trusted_texts(spark):
    """Verdicts against limits computed from all ratios in one place; junk goes, clean texts stay."""
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = {i for i, l in labels.items() if l.quality == 1 and not l.toxic}
    rows = queries.op9_compression_rules(spark, folder).collect()
    ratios: dict = {}
    for r in rows:
        if r.doc_id in good and not r.base_failed and r.n_bytes >= rules.LEAST:
            ratios.setdefault(math.floor(2 * math.log2(r.n_bytes)), []).append(math.floor(r.zstd_ratio * 1000))
    known = {}
    for c, values in ratios.items():
        values.sort()
        if len(values) >= rules.MEMBERS:
            low = next(v for k, v in enumerate(values) if sum(x <= v for x in values) > 0.001 * len(values))
            high = next(v for v in values if sum(x <= v for x in values) >= 0.999 * len(values))
            known[c] = (low / 1000 * 0.98, (high + 1) / 1000 * 1.02)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in rows[::7]:
        fixed = rules.judge(texts[r.doc_id])[6]
        low, high = known.get(math.floor(2 * math.log2(r.n_bytes)) if r.n_bytes >= rules.LEAST else None, (0, 99))
        assert r.kept == (fixed and low <= r.zstd_ratio <= high)
    passed = [r for r in rows if not r.base_failed]
    kept = [sum(r.kept for r in passed if r.doc_id in group) / sum(r.doc_id in group for r in passed) for group in (good, {i for i, l in labels.items() if l.quality == 0})]
    print("kept of good and of junk that pass the base rules:", kept)
    assert kept[0] >= 0.99 and kept[1] <= 0.4
