"""Shared plumbing of the training-data operators: staging, guarded broadcasts, byte-safe text columns.

Staged tables live below ``spark.checkpoint.dir`` (a folder that every executor and the driver
share), so a lost executor never takes the only copy of an intermediate result with it.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmeter.sources.staging import read_table, scratch_path

#: A staged side is broadcast only below both bounds; beyond them the join shuffles.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20
#: Texts in an Arrow batch.
BATCH_ROWS = 1_000


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._inkmeter_path = path
    return back


def drop_staged(staged: DataFrame) -> None:
    """Remove a staged table that no later plan reads."""
    spark = staged.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(staged._inkmeter_path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def staged_bytes(staged: DataFrame) -> int:
    spark = staged.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(staged._inkmeter_path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def broadcast_if_small(side: DataFrame, staged: DataFrame | None = None, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if the staged table (or the one that ``side`` projects) is measured within the bounds."""
    staged = side if staged is None else staged
    if staged_bytes(staged) <= size and staged.count() <= rows:
        return F.broadcast(side)
    return side


def give_back() -> None:
    """Hands memory that a task has freed back to the system, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable) -> Callable:
    """An Arrow iterator function that gives memory back when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that what an operator adds beside it cannot clash with a name in it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts to ``BATCH_ROWS`` where the session has Spark's default of 10,000."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{table}.parquet")
