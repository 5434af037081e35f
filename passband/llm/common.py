"""Shared helpers: tables, staged copies, size-checked broadcasts and word patterns."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passband.session import shared_folder

#: Words of the byte form of a text: everything between the six ASCII white-space characters.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

#: Bytes a side may hold to be broadcast; larger sides are joined by Spark's shuffled joins.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, and read back.

    The copy cuts the lineage and outlives lost executors.  It goes when the session ends.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(place)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, hinted for broadcast if its counted rows of ``row_bytes`` bytes fit ``limit``.

    ``df`` should be a stored table: it is counted here and read again by the join.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def text_key(text: Column) -> Column:
    """A 64-bit stand-in for a text, so that rows are told apart without moving texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def keyed(docs: DataFrame, keys: DataFrame) -> Column:
    """The condition that a row of ``docs`` has the doc_id and text of a row of ``keys``.

    Columns are taken from their tables and not by name: ``docs`` may have columns named alike.
    """
    return docs["doc_id"].eqNullSafe(keys["_doc_id"]) & (text_key(docs["text"]) == keys["_text_key"])


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text) is not among ``dropped`` (doc_id, text_key).

    Texts are not shuffled while the dropped keys fit a broadcast.
    """
    gone = small(stored(renamed(dropped)), 32)
    return docs.join(gone, keyed(docs, gone), "left_anti")


def renamed(keys: DataFrame) -> DataFrame:
    return keys.select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key")).distinct()


def replaced(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """``batch`` with columns added or replaced by name."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, values in columns.items():
        if name in names:
            arrays[names.index(name)] = values
        else:
            names.append(name)
            arrays.append(values)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def slices(
    batches: Iterator[pa.RecordBatch], text: str, rows: int, octets: int
) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows and about ``octets`` bytes of ``text``.

    A single row that is longer stands alone, whole.
    """
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch[text]), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or size + n > octets):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)
