"""Running statistics of a growing trace by Structured Streaming (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.trace_csv import SCHEMA


def trace_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(path)


def running_stats(trace: DataFrame) -> DataFrame:
    """Count, total and mean for each task name and device; state is a row for each pair."""
    return trace.groupBy("taskname", "acclname").agg(F.count("*").alias("n"), F.sum("duration").alias("total"), F.avg("duration").alias("mean"))


def windowed_stats(trace: DataFrame, time: str, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Statistics of event-time windows; rows later than ``late`` are left out and state is dropped."""
    return trace.withWatermark(time, late).groupBy(F.window(time, width), "acclname").agg(F.count("*").alias("n"), F.sum("duration").alias("total"))


def start(stats: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run over what is there and keep the result as an in-memory table ``name``."""
    return stats.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
