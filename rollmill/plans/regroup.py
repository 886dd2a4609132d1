"""From uploaded answers to padded training rows by way of the question pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.operators.batching import DRAW_SIZE, POOL_SIZE, keep_last, regroup
from rollmill.plans.grpo import batch_messages

TRAIN_SIZE = 4


def regrouped(uploads: DataFrame, n: int = POOL_SIZE, size: int = DRAW_SIZE, seed: int = 0) -> DataFrame:
    """Keep the newest answers of each question, then draw one normalised group from each pool."""
    return regroup(keep_last(uploads, n), size, seed)


def regrouped_batches(
    uploads: DataFrame, pad_id: int, n: int = POOL_SIZE, size: int = DRAW_SIZE, train: int = TRAIN_SIZE, seed: int = 0
) -> DataFrame:
    """Training batches of `train` rows from the draws; `uploads` also carry prompt and answer ids.

    Prompt and answer are merged and padded to the longest answer of the whole draw, then the draw is cut.
    A draw has `size` rows, so one task holds that many at a time.
    """
    if size % train:
        raise ValueError(f"a draw of {size} answers has no whole batches of {train}")
    drawn = regrouped(uploads, n, size, seed).withColumn("rollout_idx", F.col("arrival"))
    whole = batch_messages(drawn, pad_id, ("q",))
    cut = whole.withColumn("micro_batch", F.explode(F.sequence(F.lit(0), F.lit(size // train - 1))))
    start = F.col("micro_batch") * train + 1
    return cut.select(
        "q", "micro_batch", "plen", *[F.slice(c, start, F.lit(train)).alias(c) for c in ("inputs", "rewards")]
    )
