"""Pools, draws, batches, visiting orders and curricula."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollmill.functions.keys import seeded_key
from rollmill.operators.scan import (
    BUCKET_WIDTH,
    key_bucket,
    ranked,
    ranked_by_ranges,
    totals_by_ranges,
    width_bucket,
)

POOL_SIZE = 100
DRAW_SIZE = 8
POOL_TOLERANCE = 0.1


def _limited_rank(df: DataFrame, by: Sequence[str], order: Column, n: int) -> DataFrame:
    """First `n` rows per group. Each task cuts its own share to `n` rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_place", place).where(F.col("_place") <= n)


def keep_last(df: DataFrame, n: int = POOL_SIZE, by: Sequence[str] = ("q",), arrival: str = "arrival") -> DataFrame:
    """The newest `n` answers of each question."""
    return _limited_rank(df, by, F.col(arrival).desc(), n).drop("_place")


def regroup(
    df: DataFrame,
    size: int = DRAW_SIZE,
    seed: int = 0,
    tol: float = POOL_TOLERANCE,
    by: Sequence[str] = ("q",),
    ids: Sequence[str] = ("q", "arrival"),
    reward: str = "reward",
) -> DataFrame:
    """Draw `size` answers per question without replacement, drop flat draws, normalise without eps.

    A draw holds `size` rows at most, so windows over it are small whatever the pool holds.
    """
    drawn = _limited_rank(df.withColumn("_key", seeded_key(seed, *ids)), by, F.col("_key"), size)
    whole = Window.partitionBy(*by)
    r = F.col(reward)
    stats = {
        "_n": F.count(F.lit(1)).over(whole),
        "_low": F.min(r).over(whole),
        "_high": F.max(r).over(whole),
        "_mean": F.avg(r).over(whole),
        "_std": F.stddev_samp(r).over(whole),
    }
    kept = drawn.withColumns(stats).where(
        (F.col("_n") >= size) & ~(F.col("_high") <= F.col("_low") + tol)
    )
    advantage = F.try_divide(r - F.col("_mean"), F.col("_std"))
    return kept.withColumn("advantage", advantage).drop("_key", "_place", *stats)


def micro_batches(
    df: DataFrame,
    size: int,
    by: Sequence[str] = ("q_id",),
    order: str = "rollout_idx",
    name: str = "micro_batch",
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Consecutive chunks of `size` answers inside a group, numbered from zero."""
    placed = ranked(df, by, [order], width_bucket(order, width), "_place")
    return placed.withColumn(name, F.floor((F.col("_place") - 1) / size)).drop("_place")


def shuffle_batches(
    df: DataFrame,
    size: int,
    seed: int = 0,
    draw: str = "draw_id",
    ids: Sequence[str] = ("q_id", "rollout_idx"),
    name: str = "micro_batch",
    parts: int | None = None,
) -> DataFrame:
    """Batches of `size` answers in random order across the questions of one draw.

    A draw of any size is sorted by as many tasks as it has ranges of its keys, `parts` in all.
    """
    keyed = df.withColumn("_key", seeded_key(seed, *ids))
    placed = ranked_by_ranges(keyed, [draw], ["_key", *ids], "_place", parts)
    return placed.withColumn(name, F.floor((F.col("_place") - 1) / size)).drop("_place", "_key")


def macro_batches(
    index: DataFrame,
    n: int,
    by: Sequence[str] = ("producer",),
    arrival: str = "arrival",
    name: str = "macro_id",
    ties: Sequence[str] = ("batch_id",),
    parts: int | None = None,
) -> DataFrame:
    """Number the batches of each producer in arrival order, `n` to a macro batch.

    `index` has one row per batch; token rows join it afterwards. Arrivals may be of any type with an
    order and as sparse as they like. Batches that arrive together follow each other by `ties`, so the
    order is total and every evaluation numbers them alike.
    """
    placed = ranked_by_ranges(index, by, [arrival, *ties], "_place", parts)
    return placed.withColumn(name, F.floor((F.col("_place") - 1) / n)).drop("_place")


def keep_latest_macro(df: DataFrame, k: int = 3, macro: str = "macro_id", order: Sequence[str] = ()) -> DataFrame:
    """Rows of the newest `k` macro batches; the broadcast side has `k` rows.

    Newest means the greatest `order`, then the greatest `macro`; both must agree for the rows of a batch.
    """
    keys = [*order, macro]
    newest = df.select(*keys).where(F.col(macro).isNotNull()).distinct().orderBy(*[F.desc(c) for c in keys]).limit(k)
    return df.join(F.broadcast(newest), keys, "left_semi")


def saturation(
    rounds: DataFrame, run: int = 10, order: str = "round", usable: str = "usable", parts: int | None = None
) -> DataFrame:
    """Runs of at least `run` consecutive rounds without a usable group.

    All idle rounds between two usable ones have seen the same number of usable rounds.
    """
    good = F.col(usable).cast("bigint")
    seen = totals_by_ranges(rounds, [], [order], {"_seen": good}, parts)
    return (
        seen.where(~F.col(usable))
        .groupBy("_seen")
        .agg(
            F.min(order).alias("first_round"),
            F.max(order).alias("last_round"),
            F.count(F.lit(1)).alias("idle_rounds"),
        )
        .where(F.col("idle_rounds") >= run)
        .drop("_seen")
    )


def head_samples(df: DataFrame, n: int, order: str = "idx") -> DataFrame:
    """The first `n` rows in dataset order, all of them when `n` is 0."""
    return df.orderBy(order).limit(n) if n > 0 else df


def sample_k(df: DataFrame, k: int, seed: int = 0, ids: Sequence[str] = ("q_id",)) -> DataFrame:
    """Exactly `k` rows, uniformly and without replacement (all rows if there are fewer)."""
    return df.withColumn("_key", seeded_key(seed, *ids)).orderBy("_key", *ids).limit(k).drop("_key")


def draw_order(
    df: DataFrame, seed: int = 0, ids: Sequence[str] = ("q_id",), name: str = "draw_no"
) -> DataFrame:
    """Number all rows from one in a random order fixed by the seed."""
    keyed = df.withColumn("_key", seeded_key(seed, *ids))
    return ranked(keyed, [], ["_key", *ids], key_bucket("_key"), name).drop("_key")


def shuffle(df: DataFrame, seed: int = 0, ids: Sequence[str] = ("q_id",)) -> DataFrame:
    """All rows in a random visiting order; a range-partitioned sort, no numbering."""
    return df.withColumn("_key", seeded_key(seed, *ids)).orderBy("_key", *ids).drop("_key")


def delivery_order(
    df: DataFrame, mode: str, arrival: str = "arrival", name: str = "position", parts: int | None = None
) -> DataFrame:
    """Rows oldest first (`fifo`) or newest first (`lifo`), with their position from one."""
    if mode not in ("fifo", "lifo"):
        raise ValueError(f"unknown delivery mode {mode!r}")
    order = F.col(arrival).desc() if mode == "lifo" else F.col(arrival).asc()
    placed = ranked_by_ranges(df, [], [order], name, parts)
    return placed.orderBy(name)


def curriculum(
    df: DataFrame, size: int, warm: int = 1000, epochs: int = 2, idx: str = "idx"
) -> DataFrame:
    """Sequential batches of `size` questions; epochs after the first start at row `warm`.

    `idx` numbers the dataset densely from zero, so a batch number is plain arithmetic.
    """
    start = F.when(F.col("epoch") == 0, F.lit(0)).otherwise(F.lit(warm))
    visits = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return visits.where(F.col(idx) >= start).withColumn("batch", F.floor((F.col(idx) - start) / size))


def milestone(step: str | Column, n: int, extra: Sequence[int] = (), offset: int = 0) -> Column:
    """Whether a step is a multiple of `n`, or is a listed step once shifted by `offset`."""
    at = F.col(step) if isinstance(step, str) else step
    due = at % n == 0
    return due | (at + offset).isin(*extra) if extra else due
