"""Span metrics over streams: an addition to the batch operators, on the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_spans(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of Parquet span files."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_metrics(spans: DataFrame, time: str = "ts", key: str = "function_name", value: str = "duration_ms", late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Calls, mean, largest value and errors by time window and key; rows later than the watermark are dropped by Spark."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return (
        spans.withWatermark(time, late)
        .groupBy(window.alias("window"), key)
        .agg(F.count("*").alias("call_count"), F.avg(value).alias("mean"), F.max(value).alias("worst"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "call_count", "mean", "worst")
    )


def sessions(spans: DataFrame, time: str = "ts", key: str = "service_name", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of activity by key with gaps below `gap`."""
    s = spans.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("spans"))
    return s.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), key, "spans")
