"""Tumbling windows, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, key: str, width: str) -> DataFrame:
    """(window_start, key, n); event time in a UTC session."""
    out = events.groupBy(F.window(F.col(ts), width), key).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), key, "n")


def stream(spark: SparkSession, folder: str, schema, ts: str, key: str, width: str, late: str, files: int = 1) -> DataFrame:
    """The same over files that arrive; events later than the watermark drop."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return tumbling(read.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late), ts, key, width)
