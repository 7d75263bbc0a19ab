"""Tables in and intermediate files out: spreading small inputs, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes a core up to which a table of few files is dealt out; a larger one has pieces enough to be read as it is.
SMALL_SHARE = 16 << 20


def _target(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; if it is small and of fewer files than there are cores, its rows are dealt to all of them.

    A file of one row group is one task, however many cores wait. Tables beyond ``SMALL_SHARE`` a core are never
    shuffled for this.
    """
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    if len(rows._jdf.inputFiles()) >= cores:
        return rows
    place, fs = _target(spark, path)
    return rows.repartition(cores) if fs.getContentSummary(place).getLength() <= cores * SMALL_SHARE else rows


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Taken from ``spark.checkpoint.dir``. Where that is unset, a local session gets a fresh temporary
    folder (and the setting is filled in); a cluster session raises, since a machine-local folder
    would be invisible to the executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="inkmeter-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the application ends."""
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    place, fs = _target(spark, path)
    fs.deleteOnExit(place)
    return path
