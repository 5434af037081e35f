"""The pipeline: every stage on what the one before kept, and odd rows through all."""

import public_tokenizers
from cases import ODD, documents
from test_packing import check_rows
from test_near_texts import groups_of
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_take_effect(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = {i for i, l in labels.items() if l.quality == 1 and not l.toxic}
    bad = {i for i, l in labels.items() if l.quality == 0}
    before = docs.collect()
    stages = dict(corpus_pipeline.STAGES)

    one = stages["quality_classifier"](spark, docs, folder)
    assert one.columns == docs.columns
    kept = one.collect()
    ids = {r.doc_id for r in kept}
    assert len(kept) < len(before) and len(good & ids) >= 0.99 * len(good) and len(bad & ids) <= 0.5 * len(bad)

    two = stages["language_id"](spark, one, folder)
    assert two.columns == docs.columns
    named = two.collect()
    assert {r.doc_id for r in named} <= ids and len(named) >= 0.99 * len(kept)

    three = stages["near_duplicates"](spark, two, folder)
    assert three.columns == docs.columns
    single = three.collect()
    ordered = sorted(named, key=lambda r: r.doc_id)
    roots = groups_of([r.text for r in ordered])
    want, got = {ordered[i].doc_id for i in set(roots)}, {r.doc_id for r in single}
    # nothing goes that has no partner, and of the rows that should go nine of ten do at least
    assert want <= got and len(got - want) <= 0.1 * (len(ordered) - len(want))

    rows = stages["best_fit_packing"](spark, three, folder).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check_rows(rows, [(r.doc_id, r.text) for r in single], library)


def test_odd_rows(spark, tmp_path):
    spark.createDataFrame([(5, 1, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, rows in (("odd", ODD), ("empty", [])):
        docs = documents(spark, rows)
        for stage, run in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = run(spark, docs, str(tmp_path))
            if stage != "best_fit_packing":
                assert docs.columns == columns
            docs.write.parquet(f"{tmp_path}/{name}/{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}/{stage}")
        assert docs.count() >= 0


def test_run(spark):
    folder = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, folder)
    assert set(rows.columns) >= {"doc_id", "piece", "sequence_id", "offset"} and rows.count() > 0
