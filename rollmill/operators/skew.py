"""Joining group statistics back to rows when one group may hold a large share of all rows.

A window over the group would pull the whole group into one task. Here the statistics come from an
ordinary aggregation (partial sums are made before the shuffle) and are joined back in one shuffled
join on the key and a lane. An ordinary key has one lane. A hot key has lanes in proportion to its rows:
its rows go to one each, and its row of the other side is repeated for all of them.

A key is hot when it holds more than a fixed number of rows and more than one part in SHARES of them
all. So there cannot be more than SHARES hot keys, whatever the data, and the table of their lanes, two
numbers a key, is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000  # rows of a lane, at least; a key with fewer has one lane
SHARES = 100_000  # a key with less than so small a part of all rows has one lane
NULL_LANES = 4096


def group_stats(df: DataFrame, by: Sequence[str], **stats: Column) -> DataFrame:
    """One row per group with `stats` and the group's row count `_rows`. Null keys are no group."""
    known = df
    for key in by:
        known = known.where(F.col(key).isNotNull())
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in stats.items()])


def _lane_rows(stats: DataFrame, hot_rows: int) -> Column:
    """Rows of a lane: fewer than this make no key hot."""
    total = stats.agg(F.sum("_rows")).scalar()
    return F.greatest(F.lit(hot_rows).cast("double"), F.coalesce(total, F.lit(0)) / F.lit(SHARES))


def hot_groups(stats: DataFrame, by: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The groups with more rows than a lane, fewer than SHARES of them, and their number of `_lanes`."""
    size = _lane_rows(stats, hot_rows)
    return stats.where(F.col("_rows") > size).withColumn("_lanes", F.ceil(F.col("_rows") / size).cast("int"))


def _join_by_lane(
    df: DataFrame, values: DataFrame, counts: DataFrame, by: list[str], spread: Sequence[str], hot_rows: int, how: str
) -> DataFrame:
    """Join rows with a table of one row per key, by key and lane; `counts` holds `_rows` of each key in `df`."""
    key = F.xxhash64(*by)  # keys that share a hash share their number of lanes
    lanes = hot_groups(counts, by, hot_rows).groupBy(key.alias("_hot_key")).agg(F.max("_lanes").alias("_lanes"))
    lanes = F.broadcast(lanes)  # at most SHARES rows of two numbers
    missing = reduce(or_, [F.col(c).isNull() for c in by])
    apart = F.xxhash64(*spread)
    # a row without a key matches nothing, and needs no company for that
    lane = F.when(missing, -1 - F.pmod(apart, F.lit(NULL_LANES))).otherwise(F.pmod(apart, F.coalesce("_lanes", F.lit(1)).cast("long")))
    rows = df.join(lanes, key == F.col("_hot_key"), "left").withColumn("_lane", lane.cast("int")).drop("_hot_key", "_lanes")
    every = F.sequence(F.lit(0), F.coalesce("_lanes", F.lit(1)) - 1)
    side = values.join(lanes, key == F.col("_hot_key"), "left").withColumn("_lane", F.explode(every)).drop("_hot_key", "_lanes")
    return rows.join(side, [*by, "_lane"], how).drop("_lane")


def attach(
    df: DataFrame,
    stats: DataFrame,
    by: Sequence[str],
    spread: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the columns of `stats` (from `group_stats` of the same rows) to every row of `df`.

    `spread` names columns that differ between the rows of a group; they pick the lane of hot rows.
    Rows without a statistics row get NULLs.
    """
    by = list(by)
    values = [c for c in stats.columns if c not in (*by, "_rows")]
    # Reading the row count on both sides keeps their aggregations equal, so the shuffle is reused.
    side = stats.where(F.col("_rows") > 0).drop("_rows")
    return _join_by_lane(df, side, stats, by, spread, hot_rows, "left").select(*df.columns, *values)


def join_lookup(
    df: DataFrame,
    lookup: DataFrame,
    by: Sequence[str],
    spread: Sequence[str] | None = None,
    hot_rows: int = HOT_ROWS,
    how: str = "inner",
) -> DataFrame:
    """Join with a table that has one row per key, safe against hot keys in `df`; `how` is inner or left.

    AQE would split a skewed join only where no aggregation on the same key follows, and here one
    usually does. Hot keys are found by a count that reads the key columns alone, and a hot key's row of
    `lookup`, which may hold texts, is repeated once per lane and never broadcast.
    """
    by = list(by)
    values = [c for c in lookup.columns if c not in by]
    apart = list(spread or [c for c in df.columns if c not in by] or by)
    return _join_by_lane(df, lookup, group_stats(df, by), by, apart, hot_rows, how).select(*df.columns, *values)


def with_group_stats(
    df: DataFrame, by: Sequence[str], spread: Sequence[str], hot_rows: int = HOT_ROWS, **stats: Column
) -> DataFrame:
    """`group_stats` and `attach` in one step."""
    return attach(df, group_stats(df, by, **stats), by, spread, hot_rows)
