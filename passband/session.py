"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import contextlib
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Run-time settings every job here relies on.  All of them may be set on a live session.
RUNTIME = {
    # Instants are UTC nanoseconds; a session zone would move every formatted time.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # transformWithState keeps its state in column families, which only this provider has.
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # Rows here may be long texts or blocks of megabytes; ten thousand of them are no batch.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply :data:`RUNTIME` to a session somebody else built, and send it this package."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        # Python workers import the small kernels of this package by name.
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="passband-", dir="/tmp")) / "passband"
        context.addPyFile(
            shutil.make_archive(str(archive), "zip", package.parent, package.name)
        )
        _shipped.add(context.applicationId)
    return spark


def local_session(cores: int | str = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("passband")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's, or a private one where unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
        folder = tempfile.mkdtemp(prefix="passband-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextlib.contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """What is run inside has no generated method too long for the JVM to compile (8000 octets of code).

    A stage with a longer one would be interpreted row by row; its operators are compiled one by one instead.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and carry on from the written copy.

    Used where a reduced intermediate is read by several later stages.  The copy survives the
    loss of executors, unlike blocks kept on their disks.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
