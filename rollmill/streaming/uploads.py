"""Upload streams and ready-batch sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rollmill.schemas import UPLOAD
from rollmill.sources.tables import read_or_empty


def rollout_stream(
    spark: SparkSession, path: str, schema: StructType = UPLOAD, max_files: int | None = None,
    files: str | None = None,
) -> DataFrame:
    """Uploads as Parquet files dropped into a folder.

    `max_files` bounds what one trigger takes in, so a slow consumer holds producers' files back
    instead of being flooded. `files` is a file name pattern.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if files:
        reader = reader.option("pathGlobFilter", files)
    return reader.parquet(path)


def once_only(stream: DataFrame, ids: list[str], ts: str = "arrival_ts", delay: str = "10 minutes") -> DataFrame:
    """Drop repeated uploads of an answer that arrive within the delay of each other."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(ids)


def write_ready(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append finished batches exactly once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_ready(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Finished batches; no rows while none is ready."""
    return read_or_empty(spark, path, schema)
