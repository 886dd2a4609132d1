"""The sampling cursor: how many draws a run has used, kept as a one-row table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.schemas import CURSOR


def write_cursor(spark: SparkSession, path: str, value: int, step: int) -> None:
    row = spark.range(1).select(F.lit(value).cast("long").alias("value"), F.lit(step).cast("long").alias("step"))
    row.write.mode("overwrite").parquet(path)


def read_cursor(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CURSOR).parquet(path)


def after_cursor(ordered: DataFrame, cursor: DataFrame | int, draw_no: str = "draw_no") -> DataFrame:
    """Draws that a resumed run has not used yet. The order comes from `batching.draw_order`."""
    used = F.lit(cursor) if isinstance(cursor, int) else cursor.select(F.max("value")).scalar()
    return ordered.where(F.col(draw_no) > used)
