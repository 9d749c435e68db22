"""Counts over streams of new files; an addition, as the batch operators have no streaming counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_mentions(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Mentions (sid, start, end, wdid) of parquet files as they arrive."""
    return spark.readStream.schema("sid long, start int, end int, wdid string").option("maxFilesPerTrigger", files_at_once).parquet(folder)


def running_popularity(mentions: DataFrame) -> DataFrame:
    """Mentions and distinct documents (estimated) of each entity so far; state is one row an entity."""
    return mentions.groupBy("wdid").agg(F.count(F.lit(1)).alias("cnt"), F.approx_count_distinct("sid").alias("docs"))


def windowed_events(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their mean value by type and window of event time; rows later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
