"""Streaming form of first-occurrence deduplication and state counts (an extension of the batch operators)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, keys: Sequence[str], time: str, late: str = "1 day") -> DataFrame:
    """Drop repeats of a key whose first row came within ``late``; the state is bounded by the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def windowed_states(stream: DataFrame, time: str, width: str, by: Sequence[str], state: str, names: dict) -> DataFrame:
    """State counts per event-time window; with a watermark each window is final when it leaves."""
    counts = [F.count_if(F.col(state) == v).alias(n) for v, n in names.items()]
    g = stream.groupBy(F.window(time, width).alias("w"), *by).agg(*counts)
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *names.values())


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what is there and stop; the checkpoint makes the next run go on from here."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
