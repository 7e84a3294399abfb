"""Append-only JSON logs compacted as a stream: the last value of each key.

Every micro-batch adds its own last values under its number, and does so again in the same place
when it is repeated after a stop, so nothing counts twice. Reading takes the last value of all
batches; ``fold`` writes them as one. Files are the unit of the stream: one that was read is
not looked at again, so a log that goes on goes on in a new file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from frameseek.sources import files


def follow(spark: SparkSession, logs: str, table: str, checkpoint: str, key: str, value: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Starts the stream from the files of ``logs`` into ``table``; it ends when all files there are read."""

    def append(batch: DataFrame, number: int) -> None:
        # The batch's own folder, replaced as a whole: a repeated batch leaves what the first attempt left.
        files.last_wins(files.log_lines(batch, key, value), key, value).write.mode("overwrite").parquet(f"{table}/batch={number}")

    source = spark.readStream.format("text")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    return files.located(source.load(logs)).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, key: str, value: str) -> DataFrame:
    """The last value of each key over all batches, without keys whose last value is blank."""
    return files.last_wins(spark.read.parquet(table), key, value).where(F.trim(value) != "").select(key, value)


def fold(spark: SparkSession, table: str, to: str, key: str, value: str) -> None:
    """All batches as one, written to another place that ``current`` reads as well."""
    files.last_wins(spark.read.parquet(table), key, value).write.mode("errorifexists").parquet(f"{to}/batch=-1")
