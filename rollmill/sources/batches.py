"""Training batches as one table in place of length-prefixed messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.functions.text import ColumnOrName, _col
from rollmill.schemas import BATCH, META


def conform(df: DataFrame) -> DataFrame:
    """The fixed batch columns; parts that a producer does not send are NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in BATCH.fields
        ]
    )


def write_batches(df: DataFrame, path: str, mode: str = "append") -> None:
    conform(df).write.mode(mode).parquet(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BATCH).parquet(path)


def write_token_table(
    df: DataFrame, name: str, buckets: int, by: tuple[str, ...] = ("rollout_id", "pos"), mode: str = "errorifexists"
) -> None:
    """Store per-token log-probs bucketed and sorted by their key.

    Policy, generator and reference tables with the same bucketing align without a shuffle.
    """
    df.write.mode(mode).bucketBy(buckets, *by).sortBy(*by).saveAsTable(name)


def batch_meta(json: ColumnOrName) -> Column:
    """Batch metadata from its JSON text; absent keys are NULL."""
    return F.from_json(_col(json), META)
