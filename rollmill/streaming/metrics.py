"""Training metrics over a stream of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_training_stream(
    steps: DataFrame, rows: str = "n_sequences", padded: str = "padded_length", acc: str = "n_correct",
    fmt: str = "n_format",
) -> DataFrame:
    """Totals and ratios over all steps so far, in one row; use output mode `complete`."""
    n = F.sum(F.col(rows).cast("bigint"))
    return steps.groupBy().agg(
        F.count(F.lit(1)).alias("steps"),
        F.try_divide(F.sum((F.col(rows) * F.col(padded)).cast("bigint")), n).alias("avg_output_token_length"),
        F.try_divide(F.sum(F.col(acc).cast("bigint")), n).alias("acc_correct_ratio"),
        F.try_divide(F.sum(F.col(fmt).cast("bigint")), n).alias("format_correct_ratio"),
    )


def write_metrics(metrics: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Store the metrics row of each trigger in a folder of its own; `read_metrics` gives the newest.

    A reader never meets a half-written row, and a repeated trigger writes the same folder again.
    """
    def save(row: DataFrame, batch_id: int) -> None:
        row.write.mode("overwrite").parquet(f"{path}/trigger={batch_id}")

    return (
        metrics.writeStream.foreachBatch(save)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The row of the newest trigger."""
    return spark.read.parquet(path).orderBy(F.desc("trigger")).limit(1).drop("trigger")
