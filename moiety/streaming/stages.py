"""Stage durations from an event log as a stream.  An addition: nothing else here streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.sources.tables import EVENTS


def stage_stream(spark: SparkSession, folder: str, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Finished stages, their seconds and failures, by window and stage; events later than ``late`` are left out."""
    events = spark.readStream.schema(EVENTS).json(folder).withColumn("at", F.to_timestamp("timestamp")).withWatermark("at", late)
    ended = events.where(F.col("type").isin("stage_completed", "stage_failed"))
    return ended.groupBy(F.window("at", window), "stage").agg(F.count("*").alias("n"), F.sum("elapsed_seconds").alias("seconds"),
        F.count_if(F.col("type") == "stage_failed").alias("failed"))
