"""From raw documents to packed training sequences, in stages over Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from passband.llm import language, near_texts, packing, perplexity
from passband.llm.common import table, without
from passband.llm.queries import WORD_BPE
from passband.session import prepare, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the limit of their language.

    A null text is an empty one; null languages are judged by the limit of all together.
    """
    prepare(spark)
    found = perplexity.judged(perplexity.scored(docs, table(spark, sf_dir, "labels")))
    return without(docs, found.filter("NOT kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near a centroid of a language learnt from these documents.

    Texts without letters go; so do all if no document has a language.
    """
    prepare(spark)
    return language.accepted(docs, language.fit(docs.filter(language.learning(docs))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Of repeated rows one stays; all texts without words are one group.
    """
    prepare(spark)
    return near_texts.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and places; a null text is an empty one."""
    prepare(spark)
    return packing.sequences(packing.pieces(docs, WORD_BPE))


#: (name, stage): each takes (spark, docs, sf_dir), with the table of the stage before as docs.
STAGES = [
    ("quality_classifier", quality),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", pack),
]

#: Perplexities, centroids, fingerprints and packing have no SQL form; tests compare them with
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    The folder goes when the session ends.
    """
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs
