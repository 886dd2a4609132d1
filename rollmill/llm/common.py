"""What the operators share: stored tables, side files by block, salted group values.

How a table falls into partitions may change between two scans of it: executors come and go, and the
splits with them. So an operator that meets its rows again numbers them once, in a stored copy, and all
its scans read the numbers there.

A block is a bounded run of consecutive rows. An operator that scans its texts twice keeps what it
learned about a block in the shared folder under the block's number, so that the second scan picks it
up without moving a text. A scan may see a block in several parts, in different tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollmill.session import removed, run_dir, written

__all__ = [
    "BLOCK_BYTES", "block_folders", "blocks", "counted_rows", "documents", "group_value", "held_out", "labelled_sample", "numbered",
    "numbered_blocks", "removed", "run_dir", "shielded", "side_rows", "store_side", "stored", "table", "written",
]

BLOCK_BYTES = 12 << 20
BLOCKS_PER_PARTITION = 1 << 24
LANES = 4096
FETCH = 6_000_000  # counts that the driver fetches at once
PIECE = 1_000  # counts of a stored row, so that a reader's batch of rows stays small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shielded(docs: DataFrame, *reserved: str) -> tuple[DataFrame, dict[str, str]]:
    """`docs` without columns of the reserved names, and the new names of these with the old ones."""
    taken = {c.lower() for c in docs.columns} | {r.lower() for r in reserved}
    back = {}
    for c in docs.columns:
        if c.lower() in {r.lower() for r in reserved}:
            n = 0
            while f"_own{n}{c}".lower() in taken:
                n += 1
            back[f"_own{n}{c}"] = c
    return docs.withColumnsRenamed({old: new for new, old in back.items()}), back


def stored(docs: DataFrame, label: str) -> DataFrame:
    """The same rows from a table in the shared folder, tightly compressed."""
    path = run_dir(docs.sparkSession, label)
    docs.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def numbered(docs: DataFrame, label: str, number: str = "_uid") -> DataFrame:
    """A stored copy of the rows, each with a number that no other has; a column of that name is replaced."""
    return stored(docs.withColumn(number, F.monotonically_increasing_id()), label)


def _with_blocks(docs: DataFrame, text: str, limit: int, each: int = 0) -> DataFrame:
    """The rows with `_block`; a block ends with the row whose text passes `limit` bytes, `each` more counted for every row."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_block", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, size = TaskContext.get().partitionId() * BLOCKS_PER_PARTITION, 0
        for batch in batches:
            numbers = np.empty(len(batch), np.int64)
            for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
                numbers[i], size = block, size + n + each
                if size > limit:
                    block, size = block + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], [*batch.schema.names, "_block"])

    return docs.mapInArrow(cut, schema)


def numbered_blocks(docs: DataFrame, text: str, label: str, limit: int = BLOCK_BYTES, *, each: int = 0) -> DataFrame:
    """A stored copy of the rows with `_block`; a block ends with the row whose text passes `limit` bytes, `each` more counted for every row."""
    return stored(_with_blocks(docs, text, limit, each), label)


def block_folders(docs: DataFrame, text: str, label: str, limit: int) -> tuple[DataFrame, str]:
    """The same with a folder per block, and the path: whoever needs a block whole reads its folder."""
    numbered = _with_blocks(docs, text, limit)
    path = run_dir(docs.sparkSession, label)
    numbered.write.option("compression", "zstd").partitionBy("_block").parquet(path)
    return docs.sparkSession.read.schema(numbered.schema).parquet(path), path


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows without it) of each block or part of one that a task reads of `numbered_blocks`."""
    held: list[pa.RecordBatch] = []
    block = None

    def whole() -> tuple[int, pa.Table]:
        return block, pa.Table.from_batches(held).drop_columns(["_block"])

    for batch in batches:
        numbers = batch.column("_block").to_numpy()
        edges = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1], True]) if len(numbers) else []
        for start, end in pairwise(edges):
            if held and numbers[start] != block:
                yield whole()
                held = []
            block = int(numbers[start])
            held.append(batch.slice(start, end - start))
    if held:
        yield whole()


def store_side(side: DataFrame, label: str) -> str:
    """Write rows with a `block` column to one folder per block; returns the path."""
    path = run_dir(side.sparkSession, label)
    side.repartition("block").write.partitionBy("block").parquet(path)
    return path


def side_rows(path: str, block: int, number: str = "block", columns: list[str] | None = None) -> pa.Table | None:
    """What `store_side` holds for a block, or with `_block` `block_folders`; None where it holds nothing."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    folder = f"{root}/{number}={block}"
    if store.get_file_info(folder).type == fs.FileType.NotFound:
        return None
    return pq.ParquetDataset(folder, filesystem=store, partitioning=None).read(columns)


def group_value(rows: DataFrame, by: list[str], spread: Column, **values: tuple[str, Column]) -> DataFrame:
    """Add aggregates of the group to each of its rows; a group may hold any share of all rows.

    Rows meet first by (group, lane), then one row per lane by group. The values come back the same
    way, so the largest input of a task is the rows of one lane. `values` are pairs of min, max or sum
    and the column it takes. Null keys are a group as any other.
    """
    laned = rows.withColumn("_lane", F.pmod(F.xxhash64(spread), F.lit(LANES)).cast("int"))
    parts = laned.groupBy(*by, "_lane").agg(*[getattr(F, kind)(c).alias(n) for n, (kind, c) in values.items()])
    totals = parts.groupBy(*by).agg(*[getattr(F, kind)(n).alias(n) for n, (kind, _) in values.items()])
    back = _null_safe(parts.select(*by, "_lane"), totals, by).select(*by, "_lane", *values)
    return _null_safe(laned, back, [*by, "_lane"]).select(*rows.columns, *values)


def _null_safe(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    return left.join(renamed, on).drop(*[f"_r_{c}" for c in by])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its id as text is divisible by five."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """`_key`, `_label` and `text` of at most `sample` labelled rows that are not held out.

    Rows are drawn by a hash of id and text, so one of several with an id is as likely as any other; rows
    that repeat both count once. Labels other than 0 and 1 and null ids are left aside; of several labels
    of an id the largest counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    chosen = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` rows of two numbers
    keyed = rows.select("_label", "text", F.xxhash64("doc_id", "text").alias("_key"))
    # ids may repeat, so the bound on rows is drawn anew, from keys alone
    last = keyed.select("_key").distinct().orderBy("_key").limit(sample).agg(F.max("_key")).scalar()
    return keyed.where(F.col("_key") <= last).dropDuplicates(["_key"])


@dataclass(frozen=True)
class Counts:
    """Features of some rows, one row behind the other: row i from `starts[i]` to `ends[i]`."""

    labels: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray  # numbers of the features, 32 bits
    n: np.ndarray  # how often each occurs, 32 bits


def counted_rows(rows: DataFrame, count: Callable[[str | None], tuple[np.ndarray, np.ndarray]], most: int, label: str) -> Counts:
    """Features of the texts of `labelled_sample`, counted where the texts lie and stored, for the driver.

    `count` gives the numbers of a text's features and how often each occurs. Rows without a feature are
    left aside. The driver gets whole rows in the order of their keys, as many as have at most `most`
    features together, eight bytes each, and fetches FETCH of them at a time.
    """
    names = ["_key", "_label", "piece", "size", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                both = np.array(count(batch.column("text")[i].as_py()), np.int32)
                parts = [both[:, k : k + PIECE] for k in range(0, both.shape[1], PIECE)]
                if parts:
                    pieces = np.arange(len(parts), dtype=np.int32)
                    own = [batch.column(c).take(pa.array(np.full(len(parts), i))) for c in names[:2]]
                    size = pa.array([p.shape[1] for p in parts], pa.int64())
                    yield pa.RecordBatch.from_arrays([*own, pa.array(pieces), size, pa.array([p.tobytes() for p in parts])], names)

    counted = written(rows.mapInArrow(run, "_key long, _label int, piece int, size long, data binary"), label)
    sizes = counted.groupBy("_key").agg(F.max("_label").alias("_label"), F.sum("size").alias("size"))
    so_far = sizes.withColumn("_so_far", F.sum("size").over(Window.orderBy("_key")))  # three numbers a row of the sample
    slim = so_far.where(F.col("_so_far") <= most).orderBy("_key").toArrow()
    keys, labels, sizes = (slim.column(c).to_numpy() for c in ("_key", "_label", "size"))
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    total = int(ends[-1]) if len(ends) else 0
    at, n = np.empty(total, np.int32), np.empty(total, np.int32)
    first = 0
    while first < len(keys):
        last = max(int(np.searchsorted(ends, starts[first] + FETCH, "right")), first + 1)
        part = counted.where(F.col("_key").between(int(keys[first]), int(keys[last - 1]))).select("_key", "piece", "data").toArrow()
        for batch in part.to_batches():
            places = starts[np.searchsorted(keys, batch.column("_key").to_numpy())] + batch.column("piece").to_numpy().astype(np.int64) * PIECE
            for place, data in zip(places, batch.column("data"), strict=True):
                both = np.frombuffer(data.as_buffer(), np.int32).reshape(2, -1)
                at[place : place + both.shape[1]], n[place : place + both.shape[1]] = both
        first = last
    return Counts(labels.astype(np.int64), starts, ends, at, n)
