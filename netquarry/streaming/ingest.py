"""Streams of commits and events: running histories with watermarks.

The same transformations serve a stream and a table, so each can be checked
against the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """A stream of the parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def without_repeats(rows: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the watermark; state is dropped behind it."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else rows.dropDuplicates([key])


def activity(rows: DataFrame, time: str, group: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(window_start, group, n) counts per tumbling window; a window is final when the watermark has passed it."""
    marked = rows.withWatermark(time, delay) if rows.isStreaming else rows
    return marked.groupBy(F.window(time, width), group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), group, "n")


def sessions(rows: DataFrame, time: str, group: str, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """(session_start, session_end, group, n) of activity without gaps longer than ``gap``."""
    marked = rows.withWatermark(time, delay) if rows.isStreaming else rows
    return marked.groupBy(F.session_window(time, gap), group).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), group, "n")


def run_once(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there and stop; what was written before is not written again."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
