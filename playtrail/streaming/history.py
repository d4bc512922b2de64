"""Growing export directories: the batch parser run incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from playtrail.sources.history import parse_history, rejected


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Export files as they arrive, each with its whole text."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", "*.json")
        .text(path, wholetext=True)
        .select(
            F.col("_metadata.file_name").alias("file_source"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("value").alias("text"),
        )
    )


def stream_history(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Plays of export files as they arrive; same columns as the batch reader."""
    return parse_history(stream_files(spark, path, files_per_trigger))


def stream_rejected(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """What of the arriving files could not be parsed; same columns as the batch rejects."""
    return rejected(stream_files(spark, path, files_per_trigger))


def append_new_plays(plays: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append all files not seen before to a parquet table, exactly once, then stop."""
    return (
        plays.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy("content_type")
        .trigger(availableNow=True)
        .start(out)
    )
