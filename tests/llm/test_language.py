"""Operator 2: held-out accuracy and odd rows."""

import random
import zlib

import pytest
from cases import ODD, documents

from passband.llm import language, queries


def test_accuracy_on_rows_not_learnt_from(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.op2_language_id(spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in {d.lang for d in docs.values()}
    held = [r for r in got if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right / len(held) >= 0.98
    assert sum(r.accepted for r in got) / len(got) >= 0.99


@pytest.fixture(scope="module")
def model(spark):
    words = {"aa": "ba da ka la ma na pa ra sa ta", "bb": "zig zug zog zeg zyg zag zigzag zugzog"}
    rows = [(i, " ".join(words[lang].split()[i % 5 :] * (1 + i % 3)), lang) for i in range(40) for lang in words]
    return language.fit(documents(spark, rows).filter("doc_id < 30"))


def test_odd_rows(spark, model):
    rows = [*ODD, (20, "ka la ma na pa ra sa ta ba da ka la", "bb"), (21, "zigzag zug", None), (22, "中文字符很多", "aa")]
    found = language.identified(documents(spark, rows), model).collect()
    assert len(found) == len(rows)
    by_text = {r.text: r for r in found}
    assert by_text["ka la ma na pa ra sa ta ba da ka la"].lang_pred == "aa" and by_text["zigzag zug"].lang_pred == "bb"
    for text in (None, "", " \t\n", "12 34 !?"):
        assert (by_text[text].lang_pred, by_text[text].score, by_text[text].accepted) == ("und", 0.0, False)
    assert by_text["中文字符很多"].lang_pred in ("aa", "bb") and not by_text["中文字符很多"].accepted
    assert by_text["ka la ma na pa ra sa ta ba da ka la"].accepted
    kept = language.accepted(documents(spark, rows), model)
    assert kept.columns == documents(spark, []).columns and kept.filter("lang = 'bb'").first().text.startswith("ka la ma")


def test_nothing_to_learn_from(spark):
    empty = language.fit(documents(spark, [(1, "words", None), (2, "1 2", "en")]))
    assert empty.languages == []
    found = language.identified(documents(spark, ODD), empty).collect()
    assert {(r.lang_pred, r.score, r.accepted) for r in found} == {("und", 0.0, False)}
    assert language.identified(documents(spark, []), empty).count() == 0


def test_several_centroids_per_language(model):
    assert list(model.owner).count(0) == language.CLUSTERS


ITALIAN = (
    "Gli uomini che vivevano vicino al fiume andavano ogni giorno nei campi e tornavano a casa la sera, quando i bambini "
    "e gli anziani li aspettavano davanti al fuoco. Durante l'inverno il ghiaccio copriva tutta l'acqua e i mercanti delle "
    "città lontane arrivavano con le loro merci. Nel mezzo del cammino di nostra vita mi ritrovai per una selva oscura. "
)


def test_rejection_in_latin_script(spark):
    """Random letters and a language not learnt go, though short junk is among the learning texts; good texts stay."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.fit(docs.filter(language.learning(docs)))
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    strange = [" ".join(word() for _ in range(n)) for n in (30, 60, 200, 1000) for _ in range(25)]
    strange += [ITALIAN, ITALIAN * 5]
    assert not any(ok for _, _, ok in language.predictions(strange, model))
    good = spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1 AND NOT coalesce(CAST(toxic AS boolean), false)")
    clean = [r.text for r in docs.join(good, "doc_id", "left_semi").collect()]
    assert sum(ok for _, _, ok in language.predictions(clean, model)) / len(clean) >= 0.99
