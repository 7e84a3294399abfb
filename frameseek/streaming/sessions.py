"""Structured Streaming extension: sessions of a video's events, batch or stream.

The same plan runs on a stream with a watermark; late events past it are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(frames: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """Per video and session (events at most ``gap`` apart): first event and count. ``frames``: video_id, us, at."""
    rows = frames.withWatermark("at", watermark) if watermark else frames
    # A session window ends before an event exactly ``gap`` later; one microsecond more includes it.
    wide = f"{gap} 1 microsecond"
    return rows.groupBy("video_id", F.session_window("at", wide)).agg(F.min("us").alias("first_us"), F.count(F.lit(1)).alias("n"))


def stream_events(spark, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream over the parquet files of ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
