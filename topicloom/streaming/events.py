"""Structured Streaming over the event table: windows with late data, and running concept counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")


def windowed(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by tumbling window; works on streams and on tables."""
    if events.isStreaming:  # watermarks need a timestamp with a zone
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def concept_counts(items: DataFrame) -> DataFrame:
    """Running document frequencies, for update mode."""
    from ..functions.text import word_concepts

    return items.select(F.explode(word_concepts(F.col("prompt"))).alias("concept")).groupBy("concept").agg(F.count(F.lit(1)).alias("df"))
