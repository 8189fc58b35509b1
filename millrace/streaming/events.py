"""Event streams: windowed counts that accept late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and values by window and event type, of a stream or a table."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp"))
    source = source.withWatermark("ts", late) if events.isStreaming else source
    return source.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The parquet files of a folder as they come."""
    return spark.readStream.schema(like.schema).parquet(folder)
