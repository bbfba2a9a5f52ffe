"""Finished matches as a stream: each match once, within a watermark, appended to the history table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finished_matches(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows of a stream with game_id and ended_at; repeats within the delay go."""
    done = stream.where(F.col("ended_at").isNotNull()).withColumn("ended_at", F.col("ended_at").cast("timestamp"))
    return done.withWatermark("ended_at", delay).dropDuplicatesWithinWatermark(["game_id"])


def start(stream: DataFrame, path: str, checkpoint: str, delay: str = "1 day"):
    """Append the stream to a Parquet history and stop when it has caught up."""
    return finished_matches(stream, delay).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
