"""Macro batches assembled from a stream of uploaded batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rollmill.operators.batching import keep_latest_macro, macro_batches
from rollmill.operators.sequences import rfpp_advantage
from rollmill.operators.skew import join_lookup
from rollmill.sources.tables import read_or_empty


def evict_stale(df: DataFrame, k: int = 3, macro: str = "macro_id", order: tuple[str, ...] = ()) -> DataFrame:
    """Within a trigger, keep the newest macro batches only."""
    return keep_latest_macro(df, k, macro, order)


def macro_stream(
    rollouts: DataFrame, path: str, checkpoint: str, n: int, beta: float = 0.01, keep: int | None = None,
    announced: str = "batch_rows", trigger: dict | None = None,
) -> StreamingQuery:
    """Every `n` whole batches of a producer become one macro batch with its token advantages.

    `rollouts` are wide answer rows with `producer`, `batch_id`, `arrival`, `rollout_id` and `announced`,
    the number of rows their batch has. A batch may come in any number of files and triggers, and an
    answer more than once: it counts as whole when as many answers as announced are there. The whole
    batches of a trigger and of those before it that still wait follow each other by the least arrival of
    their rows, then by id. Incomplete batches, and whole ones short of a macro batch, wait below `waiting`
    for the next trigger; of the latter a producer has n-1 at most. A macro batch is named by the id of its
    first batch. With `keep`, a trigger passes on its newest macro batches only.
    """
    schema = T.StructType([f for f in rollouts.schema.fields])
    batch = ["producer", "batch_id"]

    def assemble(new: DataFrame, batch_id: int) -> None:
        spark = new.sparkSession
        waiting = read_or_empty(spark, f"{path}/waiting/batch={batch_id - 1}", schema)
        taken = f"{path}/taken/batch={batch_id}"
        arrived = waiting.unionByName(new.select(*schema.names)).dropDuplicates([*batch, "rollout_id"])
        arrived.write.mode("overwrite").parquet(taken)
        rows = spark.read.schema(schema).parquet(taken)
        index = rows.groupBy(*batch).agg(
            F.min("arrival").alias("arrival"), F.count(F.lit(1)).alias("_seen"), F.max(announced).alias("_announced")
        )
        whole = index.where(F.col("_seen") >= F.col("_announced")).select(*batch, "arrival")
        placed = macro_batches(whole, n, name="_macro")
        first = F.min_by("batch_id", F.struct("arrival", "batch_id"))
        sizes = placed.groupBy("producer", "_macro").agg(
            F.count(F.lit(1)).alias("_n"), first.alias("macro_id"), F.min("arrival").alias("_first")
        )
        named = placed.drop("arrival").join(sizes.where(F.col("_n") == n), ["producer", "_macro"])
        tagged = join_lookup(rows, named.select(*batch, "macro_id", "_first"), batch, ["rollout_id"], how="left")
        full = tagged.where(F.col("macro_id").isNotNull())
        if keep is not None:
            full = evict_stale(full, keep, order=("_first",))
        done = rfpp_advantage(full.drop("_first"), beta, scope=("producer", "macro_id"))
        done.write.mode("overwrite").parquet(f"{path}/macros/batch={batch_id}")
        short = tagged.where(F.col("macro_id").isNull()).select(*schema.names)
        short.write.mode("overwrite").parquet(f"{path}/waiting/batch={batch_id}")

    return (
        rollouts.writeStream.foreachBatch(assemble)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
