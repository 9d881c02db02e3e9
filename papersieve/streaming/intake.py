"""Streaming intake: new text files flow through extraction and hash de-duplication into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.sources.files import decode


def file_stream(spark: SparkSession, folder: str, suffixes: str = "*.txt") -> DataFrame:
    """(path, received, file_hash, full_text) of files as they arrive."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", suffixes).load(folder)
    return raw.select("path", F.col("modificationTime").alias("received"), F.sha2("content", 256).alias("file_hash"), F.trim(decode(F.col("content"))).alias("full_text"))


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per content within the watermark; state older than the delay is dropped."""
    return stream.withWatermark("received", delay).dropDuplicatesWithinWatermark(["file_hash"])


def event_windows(stream: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts and sums of an event stream (ts, event_type, value) per window and type; late events up to the delay count."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
