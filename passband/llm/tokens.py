"""Encoding texts to token ids and decoding ids to texts (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passband.llm.common import replaced, slices
from passband.llm.merge_automaton import codec


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encoded(docs: DataFrame, vocabulary: str | Path, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of every whole text as ``array<int>``.

    ``vocabulary`` is the path of a byte-level vocabulary file on the driver.  A null or empty text
    has no ids.  Rows are neither moved nor dropped; repeated rows are encoded each.  A column that
    is named like ``ids`` already is replaced.
    """
    docs = docs.drop(ids)
    shipped = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text("utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(shipped.value)
        for batch in slices(batches, text, 2_000, 8 << 20):
            lists = [table.encode(t or "") for t in batch[text].to_pylist()]
            ends = np.cumsum([0, *map(len, lists)], dtype="i4")
            flat = np.concatenate(lists) if lists else np.empty(0, "i4")
            yield replaced(batch, **{ids: pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    return docs.mapInArrow(run, _with(docs, ids, T.ArrayType(T.IntegerType())))


def decoded(df: DataFrame, vocabulary: str | Path, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text that its ids spell; null ids spell nothing.

    An id outside the vocabulary is an error.  Bytes that are not UTF-8 become U+FFFD.  A column
    that is named like ``text`` already is replaced.
    """
    df = df.drop(text)
    shipped = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text("utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(shipped.value)
        for batch in batches:
            texts = [table.decode(x or ()) for x in batch[ids].to_pylist()]
            yield replaced(batch, **{text: pa.array(texts, pa.string())})

    return df.mapInArrow(run, _with(df, text, T.StringType()))


def round_trip(docs: DataFrame, vocabulary: str | Path) -> DataFrame:
    """doc_id, ids and the text decoded from them: both of the above in one pass of one worker.

    Chained they would hold two workers with a table each in every task.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text("utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(shipped.value)
        for batch in slices(batches, "text", 1_000, 4 << 20):
            lists = [table.encode(t or "") for t in batch["text"].to_pylist()]
            ends = np.cumsum([0, *map(len, lists)], dtype="i4")
            flat = np.concatenate(lists)
            texts = [table.decode(x.tolist()) for x in lists]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(texts, pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, ids array<int>, decoded string"
    )


def digests(docs: DataFrame, vocabulary: str | Path) -> DataFrame:
    """Of each document: number of tokens, and digests of its ids and of the text decoded from them."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return round_trip(docs, vocabulary).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
