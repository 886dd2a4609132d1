"""Statistics, advantages and filters over the answers of one question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions.keys import seeded_key
from rollmill.functions.rewards import REWARD_BINS
from rollmill.functions.text import THINK_CLOSE, insert_after_thought, is_close, two_decimals
from rollmill.operators.scan import ranked_by_ranges
from rollmill.operators.skew import HOT_ROWS, attach, group_stats, with_group_stats
from rollmill.session import written

GROUP = ("q_id",)
SPREAD = ("rollout_idx",)
FULL_REWARD = 2.25


def _z(value: Column, mean: Column, std: Column, eps: float) -> Column:
    return F.try_divide(value - mean, std + F.lit(eps))


def group_advantage(
    df: DataFrame,
    eps: float = 1e-4,
    by: Sequence[str] = GROUP,
    reward: str = "reward",
    spread: Sequence[str] = SPREAD,
    name: str = "advantage",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(r - mean) / (sample std + eps) in each group; NULL for a group of one.

    With `eps=0` a flat group gives NULL as well.
    """
    with_stats = with_group_stats(
        df, by, spread, hot_rows, _mean=F.avg(reward), _std=F.stddev_samp(reward)
    )
    z = _z(F.col(reward), F.col("_mean"), F.col("_std"), eps)
    return with_stats.withColumn(name, z).drop("_mean", "_std")


def _flat(lowest: Column, highest: Column, tol: float, inclusive: bool) -> Column:
    """Flat means a range below the tolerance; the pool rule counts the tolerance itself too."""
    return highest <= lowest + tol if inclusive else highest - lowest < tol


def drop_flat_groups(
    df: DataFrame,
    tol: float = 1e-4,
    by: Sequence[str] = GROUP,
    reward: str = "reward",
    spread: Sequence[str] = SPREAD,
    inclusive: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Keep the groups whose rewards differ. `by` is the question, or the draw for the whole-draw rule."""
    with_stats = with_group_stats(
        df, by, spread, hot_rows, _low=F.min(reward), _high=F.max(reward)
    )
    flat = _flat(F.col("_low"), F.col("_high"), tol, inclusive)
    return with_stats.where(~flat).drop("_low", "_high")


def informative_advantage(
    df: DataFrame,
    eps: float = 1e-4,
    tol: float = 1e-4,
    by: Sequence[str] = GROUP,
    reward: str = "reward",
    spread: Sequence[str] = SPREAD,
    inclusive: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """`drop_flat_groups` then `group_advantage` with one aggregation and one join for both."""
    stats = group_stats(
        df, by, _mean=F.avg(reward), _std=F.stddev_samp(reward), _low=F.min(reward), _high=F.max(reward)
    ).where(~_flat(F.col("_low"), F.col("_high"), tol, inclusive))
    z = _z(F.col(reward), F.col("_mean"), F.col("_std"), eps)
    return (
        attach(df, stats.drop("_low", "_high"), by, spread, hot_rows)
        .where(F.col("_mean").isNotNull())
        .withColumn("advantage", z)
        .drop("_mean", "_std")
    )


def reward_histogram(df: DataFrame, bins: Sequence[str] = REWARD_BINS, reward: str = "reward") -> DataFrame:
    """Count per two-decimal reward text; the listed bins appear even when empty."""
    spark = df.sparkSession
    counts = df.groupBy(two_decimals(reward).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    empty = spark.range(1).select(
        F.explode(F.array(*[F.lit(b) for b in bins])).alias("bin"), F.lit(0).cast("bigint").alias("n")
    )
    return counts.unionByName(empty).groupBy("bin").agg(F.sum("n").alias("n"))


def group_moments(df: DataFrame, by: Sequence[str] = GROUP, reward: str = "reward") -> DataFrame:
    """Raw mean and sample variance of each group, as batches carry them."""
    return df.groupBy(*by).agg(F.avg(reward).alias("rmean"), F.var_samp(reward).alias("rvar"))


def distinct_rewards(df: DataFrame, by: Sequence[str] = GROUP, reward: str = "reward") -> DataFrame:
    return df.groupBy(*by, reward).agg(F.count(F.lit(1)).alias("n"))


def _rarity_levels(df: DataFrame, by: Sequence[str], reward: str, guard: bool, eps: float) -> DataFrame:
    """Rarity of each reward level. All rows of a level share it, so levels are what is scored.

    Over the rows of a group, 1/count has mean levels/rows and square sum equal to the sum of 1/count.
    """
    levels = df.groupBy(*by, reward).agg(F.count(F.lit(1)).alias("_n"))
    over_rows = group_stats(
        levels,
        by,
        _total=F.sum("_n"),
        _squares=F.sum(1 / F.col("_n")),
        _distinct=F.count(F.lit(1)),
        _fewest=F.min("_n"),
        _most=F.max("_n"),
    )
    mean = F.col("_distinct") / F.col("_total")
    spread_sq = F.greatest(F.col("_squares") - F.col("_distinct") * mean, F.lit(0.0))
    std = F.sqrt(F.try_divide(spread_sq, F.col("_total") - 1))
    gap = 1 / F.col("_n") - mean
    score = gap / (std + F.lit(eps))
    if guard:
        score = F.when(F.col("_fewest") == F.col("_most"), F.lit(0.0)).otherwise(score)
    return attach(levels, over_rows, by, [reward]).select(
        *by, reward, F.col("_n").alias("_rows"), score.alias("_rarity")
    )


def rarity(
    df: DataFrame,
    guard: bool = False,
    eps: float = 1e-6,
    by: Sequence[str] = GROUP,
    reward: str = "reward",
    spread: Sequence[str] = SPREAD,
    name: str = "rarity",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Standardised 1/count of the reward within its group.

    `guard` scores a group as zeros when all its rewards are equally rare (also a group of one,
    which is NULL without it). The table of levels, one row per group and reward, is stored: the rows are
    read once to count and once to be scored.
    """
    levels = written(_rarity_levels(df, by, reward, guard, eps), "rarity")
    return attach(df, levels, [*by, reward], spread, hot_rows).withColumnRenamed("_rarity", name)


def blend_rarity(
    df: DataFrame,
    w: float = 0.05,
    eps: float = 1e-4,
    by: Sequence[str] = GROUP,
    reward: str = "reward",
    spread: Sequence[str] = SPREAD,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Advantage plus `w` times the rarity of that advantage; adds `advantage` and `rarity`.

    Rows with the same reward in a group share both, so the two are put together per reward level
    and the rows are joined only once.
    """
    moments = group_stats(df, by, _mean=F.avg(reward), _std=F.stddev_samp(reward))
    levels = attach(_rarity_levels(df, by, reward, False, 1e-6), moments, by, [reward], hot_rows)
    advantage = _z(F.col(reward), F.col("_mean"), F.col("_std"), eps) + F.lit(w) * F.col("_rarity")
    scored = levels.select(*by, reward, "_rows", advantage.alias("advantage"), F.col("_rarity").alias("rarity"))
    return attach(df, written(scored, "rarity"), [*by, reward], spread, hot_rows)


def drop_flat_rarity(df: DataFrame, by: Sequence[str] = GROUP, score: str = "rarity",
                     spread: Sequence[str] = SPREAD, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Drop groups in which every rarity score is zero."""
    with_stats = with_group_stats(df, by, spread, hot_rows, _top=F.max(F.abs(score)))
    return with_stats.where(F.col("_top") > 0).drop("_top")


def stack_advantages(df: DataFrame, a: str = "advantage", b: str = "rarity") -> DataFrame:
    """Both score vectors in one long column, tagged by kind; a single narrow pass."""
    rest = [c for c in df.columns if c not in (a, b)]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("double").alias("value")) for k in (a, b)])
    return df.select(*rest, F.inline(kinds))


def insert_think(
    df: DataFrame,
    seed: int = 0,
    quirk: bool = False,
    reward: str = "reward",
    answer: str = "answer",
) -> DataFrame:
    """Give one full-reward answer per question an empty thought block behind its thought.

    The pick is the smallest seeded key, found by partial aggregation over ids alone; no text moves but
    in the join by answer. With `quirk` the new text goes to the answer whose index is the pick's position
    among the full-reward answers, not to the pick.
    """
    full = df.where(is_close(reward, F.lit(FULL_REWARD))).select("q_id", "rollout_idx")
    if quirk:
        full = ranked_by_ranges(full, GROUP, ["rollout_idx"], "_place")
        target = (F.col("_place") - 1).cast("int")
    else:
        target = F.col("rollout_idx")
    key = seeded_key(seed, "q_id", "rollout_idx")
    pick = full.groupBy("q_id").agg(F.min_by(F.struct(F.col("rollout_idx").alias("_from"), target.alias("_to")), key).alias("_p"))
    pick = pick.select("q_id", "_p.*")
    grown = F.when(F.instr(answer, THINK_CLOSE) > 0, insert_after_thought(answer))
    if not quirk:
        picked = pick.select("q_id", F.col("_to").alias("rollout_idx"), F.lit(True).alias("_picked"))
        new = F.when(F.col("_picked"), F.coalesce(grown, F.col(answer))).otherwise(F.col(answer))
        return df.join(picked, ["q_id", "rollout_idx"], "left").select(*[new.alias(answer) if c == answer else F.col(c) for c in df.columns])
    # the one text of a question that goes to another row: as many as there are questions
    texts = df.select("q_id", F.col("rollout_idx").alias("_from"), grown.alias("_new")).join(pick, ["q_id", "_from"])
    changed = texts.select("q_id", F.col("_to").alias("rollout_idx"), "_new")
    return df.join(changed, ["q_id", "rollout_idx"], "left").select(
        *[F.coalesce("_new", answer).alias(answer) if c == answer else F.col(c) for c in df.columns]
    )
