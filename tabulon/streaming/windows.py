"""Event windows: the same plan over a batch or a stream (an extension; formulas themselves know no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(event_type, hour, n, total) in tumbling hours; on a stream rows later than ``late`` are dropped."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = source.groupBy("event_type", F.window("ts", "1 hour").alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)
