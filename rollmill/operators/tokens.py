"""Token rows (one per rollout and position): masks, returns, standardisation and losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollmill.functions.arrays import clipped_surrogate, entropy_array, kl_k1, kl_k3
from rollmill.operators.scan import running_totals, width_bucket
from rollmill.operators.skew import HOT_ROWS, with_group_stats

TOKEN = ("rollout_id", "pos")
POSITIONS_PER_BUCKET = 4096
EXPONENT_STEP = 300.0  # exp of it, summed over any number of values, fits a double


def align_logps(cur: DataFrame, gen: DataFrame, ref: DataFrame, on: Sequence[str] = TOKEN) -> DataFrame:
    """Bring policy, generator and reference log-probs of a token into one row.

    Inputs bucketed by the rollout join without a shuffle.
    """
    return cur.join(gen, list(on)).join(ref, list(on))


def suffix_return(
    df: DataFrame, value: str = "reward", name: str = "return", rollout: str = "rollout_id", pos: str = "pos",
    width: int = POSITIONS_PER_BUCKET,
) -> DataFrame:
    """Sum of the token rewards from each position to the end of its sequence."""
    total = {name: F.col(value)}
    return running_totals(df, [rollout], [pos], width_bucket(pos, width), total, descending=True)


def eos_mask(
    df: DataFrame, valid: str = "valid", rollout: str = "rollout_id", pos: str = "pos", name: str = "is_eos",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Flag the last valid position; a sequence of padding only flags its final position."""
    ends = with_group_stats(
        df, [rollout], [pos], hot_rows, _valid_end=F.max(F.when(F.col(valid), F.col(pos))), _end=F.max(pos)
    )
    flag = F.col(pos) == F.coalesce("_valid_end", "_end")
    return ends.withColumn(name, flag).drop("_valid_end", "_end")


def token_reward(
    df: DataFrame, beta: float = 0.01, seq_reward: str = "seq_reward", eos: str = "is_eos",
    valid: str = "valid", name: str = "reward",
) -> DataFrame:
    """The sequence reward at the end token, minus beta times the k1 KL, zero on padding."""
    r = F.when(F.col(eos), F.col(seq_reward)).otherwise(F.lit(0.0)) - F.lit(beta) * kl_k1("gen_logp", "ref_logp")
    return df.withColumn(name, F.when(F.col(valid), r).otherwise(F.lit(0.0)))


def masked_standardize(
    df: DataFrame, value: str, scope: Sequence[str] = ("macro_id",), eps: float = 1e-5, valid: str = "valid",
    spread: Sequence[str] = TOKEN, name: str | None = None, mask_result: bool = False, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(x - mean) / (population std + eps), both over the valid tokens of the scope only."""
    inside = F.when(F.col(valid), F.col(value))
    stats = with_group_stats(
        df, scope, spread, hot_rows, _mean=F.avg(inside), _std=F.stddev_pop(inside)
    )
    z = (F.col(value) - F.col("_mean")) / (F.col("_std") + F.lit(eps))
    if mask_result:
        z = F.when(F.col(valid), z).otherwise(F.lit(0.0))
    return stats.withColumn(name or value, z).drop("_mean", "_std")


def valid_tokens(df: DataFrame, macro_step: int, scope: Sequence[str] = ("macro_id",), valid: str = "valid") -> DataFrame:
    """Valid tokens of a macro batch and their share per batch."""
    n = F.sum(F.col(valid).cast("bigint"))
    return df.groupBy(*scope).agg(n.alias("valid_tokens"), (n / macro_step).alias("num_items_in_batch"))


def _sequence_mean(df: DataFrame, per_token: Column, batch: str, rollout: str, valid: str) -> DataFrame:
    """Masked mean per sequence, then the mean of the batch."""
    ok = F.col(valid)
    total, n = F.sum(F.when(ok, per_token).otherwise(F.lit(0.0))), F.sum(ok.cast("bigint"))
    per_rollout = df.groupBy(batch, rollout).agg(F.try_divide(total, n).alias("_mean"))
    return per_rollout.groupBy(batch).agg(F.avg("_mean").alias("loss"))


def grpo_loss(
    df: DataFrame, beta: float = 0.04, clip: float = 0.2, batch: str = "batch_id", rollout: str = "rollout_id",
    cur: str = "logp", gen: str | None = "gen_logp", ref: str = "ref_logp", adv: str = "advantage",
    valid: str = "valid",
) -> DataFrame:
    """Clipped surrogate with k3 KL, averaged per sequence and then per batch."""
    per_token = -(clipped_surrogate(cur, gen, adv, clip) - F.lit(beta) * kl_k3(cur, ref))
    return _sequence_mean(df, per_token, batch, rollout, valid)


def rfpp_loss(
    df: DataFrame, num_items: str = "num_items_in_batch", clip: float = 0.2, batch: str = "batch_id",
    cur: str = "logp", gen: str = "gen_logp", adv: str = "advantage", valid: str = "valid",
) -> DataFrame:
    """Clipped token losses summed per batch, over the share of valid tokens per batch."""
    per_token = F.when(F.col(valid), -clipped_surrogate(cur, gen, adv, clip)).otherwise(F.lit(0.0))
    return df.groupBy(batch).agg((F.sum(per_token) / F.max(num_items)).alias("loss"))


def combined_loss(
    df: DataFrame, a: float = 0.0, b: float = 1.0, beta: float = 0.04, clip: float = 0.2, batch: str = "batch_id",
    rollout: str = "rollout_id", adaptor: tuple[str, str, str] = ("a_logp", "a_gen_logp", "a_advantage"),
    valid: str = "valid",
) -> DataFrame:
    """b * policy loss - a * adaptor surrogate, both from one pass over the tokens."""
    a_cur, a_gen, a_adv = adaptor
    policy = -(clipped_surrogate("logp", "gen_logp", "advantage", clip) - F.lit(beta) * kl_k3("logp", "ref_logp"))
    both = F.lit(float(b)) * policy
    if a > 0:
        both = both - F.lit(float(a)) * clipped_surrogate(a_cur, a_gen, a_adv, clip)
    return _sequence_mean(df, both, batch, rollout, valid)


def perplexity(df: DataFrame, cur: str = "logp", rollout: str = "rollout_id", valid: str = "valid") -> DataFrame:
    total = F.sum(F.when(F.col(valid), F.col(cur)).otherwise(F.lit(0.0)))
    n = F.sum(F.col(valid).cast("bigint"))
    return df.groupBy(rollout).agg(F.exp(-total / (n + F.lit(1e-8))).alias("ppl"))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Population correlation with 1e-8 under the line, so a constant column gives zero."""
    spread = F.stddev_pop(x) * F.stddev_pop(y) + F.lit(1e-8)
    return df.groupBy(*by).agg((F.covar_pop(x, y) / spread).alias("pearson"))


def mean_entropy(df: DataFrame, logits: str = "logits", valid: str = "valid", by: Sequence[str] = ()) -> DataFrame:
    """Entropy per position from its logits, averaged over the valid positions."""
    rows = df.where(F.col(valid)).select(*by, entropy_array(logits).alias("_h"))
    return rows.groupBy(*by).agg(
        (F.coalesce(F.sum("_h"), F.lit(0.0)) / (F.count("_h") + F.lit(1e-8))).alias("mean_entropy")
    )


def logsumexp(
    df: DataFrame, by: Sequence[str], value: str = "logit", step: float = EXPONENT_STEP, name: str = "lse",
) -> DataFrame:
    """Log-sum-exp per group from partial sums, whatever the size of a group or the range of its values.

    A value is a multiple of `step` and a rest whose exp fits a double. The rests of one multiple are
    summed, in each task before the shuffle, which carries one row per group and multiple instead of the
    values. The greatest multiple of a group then scales its few sums. NULL values are left out, and a
    group of them gives NULL; minus infinity adds nothing, infinity and NaN give themselves.
    """
    x, step = F.col(value).cast("double"), F.lit(float(step))
    finite = F.abs(x) < F.lit(float("inf"))  # NaN is greater than infinity
    rows = df.select(*by, x.alias("_x"), F.when(finite, F.rint(x / step)).alias("_k"))
    # beyond this a double has no digits behind the point, and the multiple is the value
    rest = F.when(F.abs(F.col("_x")) < F.lit(1e15), F.col("_x") - F.col("_k") * step).when(F.col("_k").isNotNull(), F.lit(0.0))
    parts = rows.groupBy(*by, "_k").agg(
        F.sum(F.exp(rest)).alias("_s"), F.max(F.when(F.col("_k").isNull(), F.col("_x"))).alias("_odd")
    )
    scaled = F.col("_s") * F.exp((F.col("_k") - F.col("_top")) * step)
    merged = (
        parts.withColumn("_top", F.max("_k").over(Window.partitionBy(*by)))
        .groupBy(*by)
        .agg((F.max("_top") * step + F.log(F.sum(scaled))).alias("_lse"), F.max("_odd").alias("_odd"))
    )
    endless = F.col("_odd") >= F.lit(float("inf"))
    return merged.select(*by, F.when(endless, F.col("_odd")).otherwise(F.coalesce("_lse", "_odd")).alias(name))
