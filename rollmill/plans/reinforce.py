"""From one draw of answers to macro batches with token advantages and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollmill.operators.batching import macro_batches
from rollmill.operators.sequences import return_moments, rfpp_advantage, scaled_return, with_scales
from rollmill.operators.skew import attach, join_lookup, with_group_stats
from rollmill.operators.tokens import TOKEN, rfpp_loss, token_reward
from rollmill.session import written


def rfpp_advantage_tokens(tokens: DataFrame, beta: float = 0.01, eps: float = 1e-5) -> DataFrame:
    """Token advantages on token rows; `sequences.rfpp_advantage` does the same on wide rows.

    The rows are shuffled once, by sequence: the end token, the suffix sums and the valid positions from
    each position on come from windows over one sequence, which is as long as a model's context at most.
    The moments of a macro batch, stored in a small table, give both standardisations.
    """
    whole = Window.partitionBy("rollout_id")
    onwards = whole.orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.coalesce(F.max(F.when(F.col("valid"), F.col("pos"))).over(whole), F.max("pos").over(whole))
    ended = tokens.withColumn("_end", F.col("pos") == end)
    rewarded = token_reward(ended, beta, eos="_end", name="_r")
    rows = rewarded.withColumns({"_s": F.sum("_r").over(onwards), "_v": F.sum(F.col("valid").cast("double")).over(onwards)})
    moments = written(return_moments(rows.where("valid"), ["macro_id"]), "moments")
    scaled = with_scales(attach(rows, moments, ["macro_id"], TOKEN), eps)
    return scaled.select(*tokens.columns, scaled_return(F.col("_s"), F.col("_v")).alias("advantage"))


def macro_advantages(rollouts: DataFrame, n: int, beta: float = 0.01) -> DataFrame:
    """Wide answer rows with producer, batch and arrival, assembled into macro batches of `n`."""
    keys = ["producer", "batch_id"]
    index = rollouts.groupBy(*keys).agg(F.min("arrival").alias("arrival"))
    placed = macro_batches(index, n).drop("arrival")
    tagged = join_lookup(rollouts, placed, keys, ["rollout_id"])
    return rfpp_advantage(tagged, beta, scope=("producer", "macro_id"))


def rfpp_losses(tokens: DataFrame, macro_step: int, beta: float = 0.01, clip: float = 0.2) -> DataFrame:
    """Batch losses of token rows that carry policy, generator and reference log-probs."""
    share = F.sum(F.col("valid").cast("bigint")) / macro_step
    advantages = with_group_stats(
        rfpp_advantage_tokens(tokens, beta), ["macro_id"], TOKEN, num_items_in_batch=share
    )
    return rfpp_loss(advantages, clip=clip)
