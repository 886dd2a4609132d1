"""Running totals and ranks over long sequences, in two levels.

Rows fall into buckets that are monotone in the sort order. Windows run inside one bucket only, the
bucket totals are accumulated on their own, far smaller table, and both are added. No task sorts a
whole sequence, be it a global one or one hot group.

`totals_by_ranges` takes ranges of the rows themselves as buckets: Spark samples the order and cuts it
at quantiles, so ids may be as sparse or as uneven as they like and any group may hold any share of the
rows. `running_totals` takes a bucket from the caller, where the order itself gives even ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollmill.operators.skew import HOT_ROWS, group_stats, hot_groups
from rollmill.session import written

BUCKET_WIDTH = 65_536  # width of a bucket in units of a whole-number order column
KEY_DIGITS = 4  # leading hexadecimal digits of a seeded key: 65,536 buckets


def width_bucket(order: str, width: int = BUCKET_WIDTH) -> Column:
    """Bucket of a whole-number order column."""
    return F.floor(F.col(order) / F.lit(width))


def key_bucket(key: str, digits: int = KEY_DIGITS) -> Column:
    """Bucket of a seeded key: its leading digits."""
    return F.substring(key, 1, digits)


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order_by: Sequence[str],
    bucket: Column,
    totals: dict[str, Column],
    descending: bool = False,
    coarse: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of each expression within `by`, in the order of `order_by`.

    `bucket` must be monotone in the order; rows equal in `order_by` should not matter to the caller.
    Where whole-number buckets may be sparse, such as those of timestamps, `coarse` accumulates their
    totals in two levels again, `coarse` buckets at a time.
    """
    def direction(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    values = {f"_v_{n}": e for n, e in totals.items()}
    rows = df.withColumns({"_bucket": bucket, **values})
    sums = rows.groupBy(*by, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    if coarse:
        through = running_totals(
            sums.withColumnRenamed("_bucket", "_fine"),
            by,
            ["_fine"],
            F.floor(F.col("_fine") / F.lit(coarse)),
            {f"_t_{n}": F.col(f"_s_{n}") for n in totals},
            descending,
        )
        before = {n: F.col(f"_t_{n}") - F.col(f"_s_{n}") for n in totals}
        offsets = through.withColumnRenamed("_fine", "_bucket")
    else:
        earlier = (
            Window.partitionBy(*by)
            .orderBy(direction("_bucket"))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        before = {n: F.sum(f"_s_{n}").over(earlier) for n in totals}
        offsets = sums
    offsets = offsets.select(*by, "_bucket", *[c.alias(f"_o_{n}") for n, c in before.items()])
    offsets = offsets.where(reduce(or_, [F.col(f"_o_{n}").isNotNull() for n in totals]))
    inside = (
        Window.partitionBy(*by, "_bucket")
        .orderBy(*[direction(c) for c in order_by])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.withColumns({f"_w_{n}": F.sum(f"_v_{n}").over(inside) for n in totals})
    zero = F.lit(0)
    return local.join(offsets, [*by, "_bucket"], "left").select(
        *[F.col(c) for c in df.columns if c not in totals],
        *[(F.col(f"_w_{n}") + F.coalesce(f"_o_{n}", zero)).alias(n) for n in totals],
    )


def ranked(
    df: DataFrame,
    by: Sequence[str],
    order_by: Sequence[str],
    bucket: Column,
    name: str = "rank",
    descending: bool = False,
    coarse: int | None = None,
) -> DataFrame:
    """One-based row number within `by`; `order_by` must be unique within it."""
    one = F.lit(1).cast("bigint")
    return running_totals(df, by, order_by, bucket, {name: one}, descending, coarse)


def totals_by_ranges(
    df: DataFrame,
    by: Sequence[str],
    order_by: Sequence[str | Column],
    totals: dict[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """Add inclusive running sums of each expression within `by`, in the order of `order_by`.

    The rows are range partitioned by `by` and the order, which cuts large groups at quantiles of their
    own order, and stored with the number of their partition; `parts` is the number of partitions
    (Spark's by default). Sums inside a partition and the totals of the group's earlier partitions give
    the result. Of the groups in a partition only the first can have begun in an earlier one, so the
    table of totals has at most one row per partition. Null keys are a group as any other; rows equal
    in `order_by` should not matter to the caller, and lie in one partition.
    """
    by = list(by)
    orders = [F.col(c) if isinstance(c, str) else c for c in order_by]
    valued = df.withColumns({f"_v_{n}": e for n, e in totals.items()})
    count = [] if parts is None else [parts]
    ranged = valued.repartitionByRange(*count, *by, *orders).withColumn("_part", F.spark_partition_id())
    rows = written(ranged, "ranges")
    sums = rows.groupBy(*by, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sums.select(
            *[F.col(c).alias(f"_by_{c}") for c in by],
            F.col("_part").alias("_at"),
            F.lag(F.lit(1)).over(Window.partitionBy(*by).orderBy("_part")).alias("_began"),
            *[F.sum(f"_s_{n}").over(earlier).alias(f"_o_{n}") for n in totals],
        )
        .where(F.col("_began").isNotNull())
        .drop("_began")
    )
    inside = Window.partitionBy(*by, "_part").orderBy(*orders).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({f"_w_{n}": F.sum(f"_v_{n}").over(inside) for n in totals})
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    joined = local.join(F.broadcast(offsets), [F.col("_part") == F.col("_at"), *same], "left")
    zero = F.lit(0)
    return joined.select(
        *[F.col(c) for c in df.columns if c not in totals],
        *[(F.coalesce(f"_w_{n}", zero) + F.coalesce(f"_o_{n}", zero)).alias(n) for n in totals],
    )


def ranked_by_ranges(
    df: DataFrame, by: Sequence[str], order_by: Sequence[str | Column], name: str = "rank", parts: int | None = None
) -> DataFrame:
    """One-based row number within `by`; `order_by` should be unique within it."""
    return totals_by_ranges(df, by, order_by, {name: F.lit(1).cast("bigint")}, parts)


def bucket_hot_groups(
    df: DataFrame, by: Sequence[str], bucket: Column, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, Column]:
    """Keep ordinary groups in one bucket and cut only hot ones, by the given bucket.

    Returns the marked rows and the bucket column to hand to `ranked` or `running_totals`.
    """
    hot = hot_groups(group_stats(df, by), by, hot_rows).select(*by, F.lit(True).alias("_is_hot"))
    marked = df.join(F.broadcast(hot), list(by), "left")  # fewer than SHARES keys
    return marked, F.when(F.col("_is_hot"), bucket)
