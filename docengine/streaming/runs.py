"""Streams of run events: tumbling counts, sessions, running averages, document arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """A stream over Parquet files of events; timestamps are made zoned, as watermarks need."""
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """ST-X2."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """ST-X3."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def running_averages(events: DataFrame) -> DataFrame:
    """ST-X4: mean value of each template so far."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def arriving_files(spark: SparkSession, folder: str) -> DataFrame:
    """ST-X1: files as they arrive."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All available input through a memory table; for tests and small summaries."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
