"""The request log as a stream: windowed latency by component, late records bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def request_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Events as they arrive as Parquet files in `folder`."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_latency(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, mean, peak) per window; works on a stream and on a table alike."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("peak"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "mean", "peak")
    )


def write_windows(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write finished windows as Parquet until the input so far is used up."""
    return windowed_latency(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
