"""Operator 6: the automaton against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from cases import ODD, documents
from tokenizers import Tokenizer

from passband.llm import queries, tokens
from passband.llm.merge_automaton import Codec, MergeAutomaton

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return Codec(open(PATH, encoding="utf-8").read())


def by_merging(word, merges):
    parts = [word[i : i + 1] for i in range(len(word))]
    for left, right in merges:
        i = 0
        while i < len(parts) - 1:
            if (parts[i], parts[i + 1]) == (left, right):
                parts[i : i + 2] = [left + right]
            i += 1
    return parts


def test_every_sequence_of_merges():
    rng = random.Random(5)
    for _ in range(300):
        made, merges = [b"a", b"b", b"c"], []
        for _ in range(rng.randint(1, 9)):
            pair = (rng.choice(made), rng.choice(made))
            if pair[0] + pair[1] not in made:
                merges.append(pair)
                made.append(pair[0] + pair[1])
        automaton = MergeAutomaton({t: i for i, t in enumerate(made)}, merges)
        for _ in range(40):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
            got = automaton.encode(word)
            assert [automaton.labels[i] for i in got] == by_merging(word, merges), (word, merges)
            assert automaton.decode(got) == word


def test_against_library(codec, library):
    rng = random.Random(1)
    odd = "aabbtthheeiinn  \n\t\x1c\x85'sS <|endoftext|>éßñ中文字😀٣½²,.!?İ́​"
    for i in range(4000):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 40)))
        if i % 4 == 0:
            text = text.replace("a", "<|endoftext|>", 1)
        if i % 5 == 0:
            text = "".join(chr(rng.choice((rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0x10000, 0x1FFFF)))) for _ in range(20))
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == want, text
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False)


def test_odd_rows(spark, library):
    docs = documents(spark, ODD)
    rows = tokens.decoded(tokens.encoded(docs, PATH), PATH).collect()
    assert len(rows) == len(ODD) and set(docs.columns) <= set(rows[0].asDict())
    for r in rows:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    assert tokens.digests(docs.limit(0), PATH).count() == 0


def test_whole_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op6_bpe_round_trip(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
