"""Recordings: files to chunk tables, streams of chunks and messages, the recording sink."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from passband.schemas import CHUNK, MESSAGE

CHUNK_OCTETS = 1 << 16
#: Octets of a file that one task reads, and that it holds at a time.
RANGE_OCTETS, BATCH_OCTETS = 64 << 20, 4 << 20


def ranges(spark: SparkSession, path: str, unit: int, range_octets: int = RANGE_OCTETS) -> DataFrame:
    """path, modified, low, high: files cut at multiples of ``unit``, about ``range_octets`` each.

    Only names and lengths are listed; the content column is not read.
    """
    if unit < 1:
        raise ValueError("a unit must hold at least one octet")
    step = max(1, range_octets // unit) * unit
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", F.col("length").cast("bigint").alias("length"))
    low = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(step).cast("bigint")))
    cut = files.filter(F.col("length") > 0).select("path", F.col("modificationTime").alias("modified"), "length", low.alias("low"))
    return cut.withColumn("high", F.least(F.col("low") + step, F.col("length"))).drop("length")


def _units(parts: DataFrame, unit: int) -> DataFrame:
    """path, modified, number, start, octets: the units of ranges, read by the tasks that hold them.

    Files are opened by pyarrow, which reads local paths, HDFS and object stores, and only the octets
    of a range are asked for.  A task holds some units at a time.
    """
    most = max(1, BATCH_OCTETS // unit)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, modified, low, high in zip(*(batch[c] for c in ("path", "modified", "low", "high"))):
                store, name = opened(path.as_py())
                at, end = low.as_py(), high.as_py()
                with store.open_input_file(name) as file:
                    while at < end:
                        octets = file.read_at(min(most * unit, end - at), at)
                        if not octets:
                            raise OSError(f"{path}: the file is shorter than it was when it was listed")
                        starts = range(0, len(octets), unit)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([path.as_py()] * len(starts)),
                                pa.array([modified.as_py()] * len(starts), batch["modified"].type),
                                pa.array([(at + s) // unit for s in starts], pa.int64()),
                                pa.array([at + s for s in starts], pa.int64()),
                                pa.array([octets[s : s + unit] for s in starts], pa.binary()),
                            ],
                            names=["path", "modified", "number", "start", "octets"],
                        )
                        at += len(octets)

    # ranges are dealt out one by one: a single large file is read by many tasks
    spread = parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "low")
    return spread.mapInArrow(read, "path string, modified timestamp, number bigint, start bigint, octets binary")


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a file named by Spark, and its name there."""
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), unquote("/" + uri.removeprefix("file:").lstrip("/"))
    return pa.fs.FileSystem.from_uri(uri)


def scan(
    spark: SparkSession, path: str, chunk_octets: int = CHUNK_OCTETS, *, range_octets: int = RANGE_OCTETS
) -> DataFrame:
    """Whole files as ordered chunks; every range of a file is read by a task of its own."""
    if chunk_octets < 1:
        raise ValueError("a chunk must hold at least one octet")
    read = _units(ranges(spark, path, chunk_octets, range_octets), chunk_octets)
    return read.select(
        F.col("path").alias("capture_id"),
        F.lit(0).alias("epoch"),
        F.col("number").alias("chunk_no"),
        F.col("start").alias("offset"),
        F.col("modified").alias("received"),
        F.col("octets").alias("bytes"),
    )


def fixed_records(
    spark: SparkSession, path: str, length: int, *, range_octets: int = RANGE_OCTETS
) -> DataFrame:
    """Every ``length`` octets of a file is one record: capture_id, frame_no, start, frame.

    What is left at the end of a file, shorter than a record, is none.
    """
    if length < 1:
        raise ValueError("a record must hold at least one octet")
    read = _units(ranges(spark, path, length, range_octets), length)
    return read.filter(F.length("octets") == length).select(
        F.col("path").alias("capture_id"), F.col("number").alias("frame_no"), "start", F.col("octets").alias("frame")
    )


def replay(
    spark: SparkSession,
    path: str,
    *,
    octets_per_trigger: int | None = None,
    files_per_trigger: int | None = None,
    laps: int = 1,
) -> DataFrame:
    """A stored pass as a stream of chunks, paced by admission; every lap is a new epoch."""
    if laps < 1:
        raise ValueError("a replay runs at least once")
    reader = spark.readStream.schema(CHUNK)
    if octets_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", int(octets_per_trigger))
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", int(files_per_trigger))
    stored = reader.parquet(path)
    lap = F.explode(F.sequence(F.lit(0), F.lit(laps - 1)))
    return stored.withColumn("_lap", lap).withColumn("epoch", F.col("epoch") * laps + F.col("_lap")).drop("_lap")


def messages(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of messages; nothing carries from one row to the next."""
    return (
        spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def record(chunks: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append every received chunk, unmodified, before any framing."""
    return (
        chunks.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def append(chunks: DataFrame, path: str) -> None:
    """The batch form of :func:`record`."""
    chunks.write.mode("append").parquet(path)
