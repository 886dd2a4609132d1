"""The same token mathematics for wide rows: one row per answer, one array entry per position.

Everything that stays inside a sequence happens inside its row, so only statistics across sequences
shuffle, and they shuffle answers instead of tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions.arrays import clipped_surrogate, kl_k3, suffix_sums
from rollmill.functions.text import ColumnOrName, _col
from rollmill.operators.skew import HOT_ROWS, attach, group_stats


def last_valid(valid: ColumnOrName) -> Column:
    """Zero-based index of the last valid position, or of the final one if all is padding."""
    v = _col(valid)
    from_end = F.array_position(F.reverse(v), True)
    return F.when(from_end > 0, F.size(v) - from_end).otherwise(F.size(v) - 1)


def token_rewards(
    seq_reward: ColumnOrName, gen: ColumnOrName, ref: ColumnOrName, valid: ColumnOrName, beta: float = 0.01
) -> Column:
    """Per position: the sequence reward at the end token minus beta times the KL, zero on padding."""
    end = last_valid(valid)
    penalty = F.zip_with(_col(gen), _col(ref), lambda g, r: -F.lit(beta) * (g - r))

    def reward(x: Column, i: Column) -> Column:
        whole = x + F.when(i == end, _col(seq_reward)).otherwise(F.lit(0.0))
        return F.when(F.get(_col(valid), i), whole).otherwise(F.lit(0.0))

    return F.transform(penalty, reward)


def return_moments(tokens: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Moments of the rewards `_r`, their suffix sums `_s` and the valid positions `_v` from each valid one on."""
    return group_stats(
        tokens,
        scope,
        _mr=F.avg("_r"),
        _dr=F.stddev_pop("_r"),
        _ms=F.avg("_s"),
        _mv=F.avg("_v"),
        _ss=F.var_pop("_s"),
        _vv=F.var_pop("_v"),
        _sv=F.covar_pop("_s", "_v"),
    )


def with_scales(joined: DataFrame, eps: float) -> DataFrame:
    """From the moments: `_d`, the scale of the rewards, and mean `_rm` and scale `_rd` of the returns."""
    mean, deviation = F.col("_mr"), F.col("_dr") + F.lit(eps)
    return_mean = (F.col("_ms") - mean * F.col("_mv")) / deviation
    return_var = (F.col("_ss") - 2 * mean * F.col("_sv") + mean * mean * F.col("_vv")) / (deviation * deviation)
    return_std = F.sqrt(F.greatest(return_var, F.lit(0.0))) + F.lit(eps)
    return joined.withColumns({"_d": deviation, "_rm": return_mean, "_rd": return_std})


def scaled_return(s: Column, v: Column) -> Column:
    return ((s - F.col("_mr") * v) / F.col("_d") - F.col("_rm")) / F.col("_rd")


def rfpp_advantage(
    df: DataFrame, beta: float = 0.01, eps: float = 1e-5, scope: Sequence[str] = ("macro_id",),
    rollout: str = "rollout_id", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Token rewards, standardised, summed to the end, standardised again; adds `advantages`.

    Both standardisations are linear in the raw rewards: with S the suffix sums of the rewards and V
    the number of valid positions from here on, the returns are (S - mean*V)/std. Their mean and
    deviation follow from the moments of S and V, so one aggregation and one join serve both rounds.
    """
    marks = F.transform("valid", lambda v: v.cast("double"))
    rows = df.withColumn("_r", token_rewards("seq_reward", "gen_logps", "ref_logps", "valid", beta))
    rows = rows.withColumns({"_s": suffix_sums("_r"), "_v": suffix_sums(marks)})
    tokens = rows.select(*scope, F.inline(F.arrays_zip("_r", "_s", "_v", "valid"))).where("valid")
    scaled = with_scales(attach(rows, return_moments(tokens, scope), scope, [rollout], hot_rows), eps)
    return scaled.select(*[F.col(c) for c in df.columns], F.zip_with("_s", "_v", scaled_return).alias("advantages"))


def grpo_sequence_loss(
    cur: ColumnOrName,
    gen: ColumnOrName,
    ref: ColumnOrName,
    adv: ColumnOrName,
    valid: ColumnOrName,
    beta: float = 0.04,
    clip: float = 0.2,
) -> Column:
    """Masked mean over the positions of one answer; NULL when all of it is padding."""
    spots = F.arrays_zip(
        _col(cur).alias("c"), _col(gen).alias("g"), _col(ref).alias("r"), _col(valid).alias("v")
    )
    spots = F.filter(spots, lambda t: t["v"])

    def add(total: Column, t: Column) -> Column:
        gain = clipped_surrogate(t["c"], t["g"], _col(adv), clip) - F.lit(beta) * kl_k3(t["c"], t["r"])
        return total - gain

    return F.try_divide(F.aggregate(spots, F.lit(0.0), add), F.size(spots))


def grpo_loss_wide(df: DataFrame, beta: float = 0.04, clip: float = 0.2, batch: str = "batch_id", adv: str = "advantage") -> DataFrame:
    """Batch loss from wide rows: no shuffle but one partial average per batch."""
    per_answer = grpo_sequence_loss("logps", "gen_logps", "ref_logps", adv, "valid", beta, clip)
    return df.select(batch, per_answer.alias("_loss")).groupBy(batch).agg(F.avg("_loss").alias("loss"))
