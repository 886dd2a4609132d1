"""Row and batch filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.operators.skew import with_group_stats


def max_prompt_tokens(df: DataFrame, n: int, ids: str = "prompt_ids") -> DataFrame:
    return df.where(F.size(ids) <= n)


def max_total_tokens(df: DataFrame, n: int = 2200, ids: str = "token_ids", batch: str = "batch_id",
                     spread: tuple[str, ...] = ("rollout_id",)) -> DataFrame:
    """Drop every batch whose padded length, its longest sequence, exceeds `n`."""
    longest = with_group_stats(df, [batch], spread, _longest=F.max(F.size(ids)))
    return longest.where(F.col("_longest") <= n).drop("_longest")


def drop_nan(df: DataFrame, col: str) -> DataFrame:
    return df.where(~F.isnan(col))


def drop_missing_logps(df: DataFrame, col: str = "gen_logps") -> DataFrame:
    return df.where(F.size(F.coalesce(F.col(col), F.array())) > 0)


def validate_batches(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split batch rows into well-formed and rejected ones.

    A batch needs its metadata, ids and rewards; ids and rewards must have one entry per sequence, and
    generator log-probs, which may be absent, must too.
    """
    one_each = F.size("inputs") == F.size("rewards")
    gens_fit = F.col("gen_logps").isNull() | (F.size("gen_logps") == F.size("inputs"))
    present = F.col("plen").isNotNull() & F.col("inputs").isNotNull() & F.col("rewards").isNotNull()
    checked = df.withColumn("_ok", F.coalesce(present & one_each & gens_fit, F.lit(False)))
    return checked.where("_ok").drop("_ok"), checked.where("NOT _ok").drop("_ok")
