"""Running summaries over a folder into which reports keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkmeter.operators.aggregate import macro_rates, merge_difference_maps
from inkmeter.sources.files import REPORT


def stream_reports(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Report files as they arrive."""
    return (
        spark.readStream.schema(REPORT).option("multiLine", "true").option("allowNonNumericNumbers", "true").option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", files_per_trigger).json(folder))


def running_rates(reports: DataFrame) -> DataFrame:
    """The macro averages so far; run it in ``complete`` mode. The state is one row."""
    return macro_rates(reports)


def running_differences(reports: DataFrame) -> DataFrame:
    """Difference counts so far, by level and key; the state is one row a distinct difference."""
    return merge_difference_maps(reports)


def start(frame: DataFrame, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps a running summary in the table ``name``; the checkpoint must be in a shared folder."""
    writer = frame.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
