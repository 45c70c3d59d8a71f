"""Shared pieces: where intermediate tables go, and how they are written and dropped."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Only where it is unset in a local session, as in tests, a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


BATCH_ROWS = 2000
#: For steps between which only numbers travel; whole texts go by ``BATCH_BYTES`` there too.
NUMBER_ROWS = 20_000
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let at most BATCH_ROWS rows (whole texts) travel to a Python worker at a time, so that its
    memory and the buffers beside the heap stay small; a lower setting of the session stands."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Let up to ``rows`` rows or BATCH_BYTES travel at a time, if the session's own setting is not lower
    than BATCH_ROWS; then as before."""
    small_batches(spark)
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {key: spark.conf.get(key) for key in wanted}
    if rows > BATCH_ROWS and int(before["spark.sql.execution.arrow.maxRecordsPerBatch"]) == BATCH_ROWS:
        for key, value in wanted.items():
            spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def give_back() -> None:
    """Return freed memory of this Python worker to the system, where Arrow and the C library can: they
    keep what large arrays and texts leave behind, and idle workers would hold that for the next tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``read`` for ``mapInArrow``, giving back what is free when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from read(batches)
        finally:
            give_back()

    return run


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver collect its garbage: the shuffle files of plans that nothing holds any more go with it,
    which else stay on the executors' disks until the driver happens to do so."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: its lineage ends at files that
    survive the loss of any executor. Returns the new frame and its path (see ``drop``).
    ``rows``: how many may travel to a Python worker at a time (see ``batches_of``)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with batches_of(spark, rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that no lazy frame reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
