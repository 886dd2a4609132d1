"""Sharding: contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollmill.llm.common import documents, written

SHARDS = 24
OVERHEAD = 8  # bytes of framing counted with each row


def balanced_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    order: str = "doc_id",
    text: str = "text",
    overhead: int = OVERHEAD,
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns `keep` (all by default) of every row with its size, shard and place within the shard.

    Rows are range partitioned by `order` and stored with their partition's number. Partition totals,
    one row each, give the bytes and rows before a partition; a window inside the partition gives those
    before a row. A row lies in the shard in whose equal share of all bytes its middle byte falls, so a
    shard misses its share by one row at most. Shards are contiguous in `order` and may be empty where
    one row is larger than a share.

    A null or empty text has `overhead` bytes. Rows without an id come first; rows with equal ids stay
    in an order of their own, fixed when they are stored, and may be cut anywhere, so one id can hold
    any share of the rows. Columns of the input named size, shard or slot are replaced. No rows give
    no rows.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("size", "shard", "slot")]
    sized = docs.withColumns(
        {
            "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead),
            "_order": F.col(order),
            "_tie": F.monotonically_increasing_id(),
        }
    ).select(*keep, "size", "_order", "_tie")
    ranged = written(sized.repartitionByRange("_order", "_tie").withColumn("_part", F.spark_partition_id()), "shards")

    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(parts), F.lit(0)).alias("_bytes"),
        F.coalesce(F.sum("_rows").over(parts), F.lit(0)).alias("_rows"),
        F.sum("_bytes").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(F.col("_order").asc_nulls_first(), "_tie")
    placed = (
        ranged.withColumns(
            {
                "_in_bytes": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"),
                "_in_rows": F.row_number().over(inside) - 1,
            }
        )
        .join(F.broadcast(offsets), "_part")  # a row for each shuffle partition
        .withColumn("shard", F.expr(f"least({shards - 1}, (2 * (_bytes + _in_bytes) + size) * {shards} div (2 * _all))").cast("int"))
        .withColumn("_row", F.col("_rows") + F.col("_in_rows"))
        .select(*keep, "size", "shard", "_row")
    )
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # a row for each shard
        *keep, "size", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )


def op1_sharding(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit(""))))
    return balanced_shards(docs, keep=["doc_id", "text_crc32"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
