"""Operator 10: pieces against the tokenizers library, bins against their rules."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import ODD, documents
from tokenizers import Tokenizer

from passband.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_chunks_against_library(library):
    table = packing.WordTokens(open(PATH, encoding="utf-8").read())
    assert table.split is not None
    rng = random.Random(2)
    odd = "aaabbttheeeLLSDREVM  \n\t\x1c\x85'sS <|endoftext|>éßñÀµ0123²½中İ́ΣςſŉſŸ,.!?"
    for i in range(4000):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 40)))
        if i % 3 == 0:
            text = "".join(chr(rng.randint(0, 0x190)) for _ in range(25))
        assert np.frombuffer(table.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def check_bins(bins, lengths, size):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= size for b in bins)


def test_local_search_empties_bins():
    rng = np.random.default_rng(3)
    better = 0
    for low, high, n in ((500, 1100, 400), (300, 900, 400), (680, 1000, 300), (1, 2049, 500), (1024, 1025, 7), (2048, 2049, 5)):
        lengths = rng.integers(low, high, n)
        first, last = packing.best_fit(lengths, 2048), packing.packed(lengths, 2048)
        check_bins(first, lengths, 2048)
        check_bins(last, lengths, 2048)
        assert len(last) <= len(first)
        better += len(last) < len(first)
    assert better >= 2
    assert packing.packed(np.array([], np.int64), 2048) == []


def test_steps_raise_squared_fill():
    rng = np.random.default_rng(4)
    lengths = rng.integers(400, 1100, 300)
    search = packing._Search(packing.best_fit(lengths, 2048), lengths, 2048)
    swap, sums = search._swap, [sum(f * f for f in search.fill)]

    def told(*step):
        swap(*step)
        sums.append(sum(f * f for f in search.fill))

    search._swap = told
    search.round()
    assert len(sums) > 5 and all(a < b for a, b in zip(sums, sums[1:]))


def check_rows(rows, texts, library, size=2048):
    """``texts``: a bag of texts by doc_id."""
    want = Counter()
    for doc, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), size)):
            part = np.array(ids[at : at + size], "<u4")
            want[doc, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), -(-sum(r.length for r in rows) // size)


def test_odd_rows_in_small_groups(spark, library):
    docs = documents(spark, ODD)
    cut = packing.pieces(docs, PATH)
    rows = packing.sequences(cut, group_pieces=3).collect()
    check_rows(rows, [(i, t) for i, t, _ in ODD], library)
    assert packing.sequences(packing.pieces(docs.limit(0), PATH)).count() == 0


def test_whole_query(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    used, least = check_rows(queries.op10_best_fit_packing(spark, folder).collect(), [(d.doc_id, d.text) for d in docs], library)
    assert used <= least + 1


def test_pieces_of_new_chunks_are_looked_up():
    """A word behind other marks is not tokenized again; odd ASCII characters are found without the pattern."""
    table = packing.WordTokens(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    text = "alphabetical, alphabetical. (alphabetical) alphabetical;"
    made, real = [], table._made
    table._made = lambda piece: made.append(piece) or real(piece)
    want = table.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(table.ids(text), "<u4").tolist() == want and made.count("alphabetical") == 1
    assert all(table.is_odd(f"a{chr(c)}b") == (table.odd(f"a{chr(c)}b") is not None) for c in range(0x250))
