"""The question pool as keyed state, and groups drawn from it.

State holds one list of answers per question and nothing else holds them: what a trigger brings of a
question is appended as one element, and a list is cut to its newest answers, one element again, when it
has doubled. What a pool was after a trigger is read from the state of that trigger, so there is no log
of changes to keep or compact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rollmill.operators.batching import DRAW_SIZE, POOL_SIZE, POOL_TOLERANCE, keep_last, regroup

MIN_TOTAL = 60
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ANSWERS = [
    T.StructField("answers", T.ArrayType(T.StringType())),
    T.StructField("rewards", T.ArrayType(T.DoubleType())),
    T.StructField("arrivals", T.ArrayType(T.LongType())),
]
_PART = T.StructType([*_ANSWERS, T.StructField("received", T.LongType())])  # `received` counts those cut as well
POOL = T.StructType([T.StructField("q", T.StringType()), *_PART]).add("fresh", "long")


def _newest_per_question(n: int):
    """Cut each Arrow batch to the newest `n` answers per question before the shuffle.

    `weight` keeps the number of answers received: the first row kept stands for those cut.
    """
    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ordered = pdf.sort_values("arrival", kind="stable")
            sizes = ordered.groupby("q")["arrival"].transform("size")
            kept = ordered.groupby("q").tail(n).copy()
            first = ~kept.duplicated("q")
            cut_off = (sizes.loc[kept.index] - n).clip(lower=0)
            kept["weight"] = 1 + cut_off.where(first, 0)
            yield kept

    return cut


def _processor(n: int) -> StatefulProcessor:
    """Appends a trigger's answers to the question's list, as one element, and emits the pool.

    Each call of the state is a message to another process and costs far more than the answers it moves,
    so one list holds all: a question is read once and written once. All it needs is defined here: Spark
    sends it by value, also to a process that cannot import this module.
    """
    part = _PART

    def newest(answers: list[tuple]) -> list[tuple]:
        """Oldest first; equal arrivals by their text and reward."""
        return sorted(answers, key=lambda a: (a[2], a[0] or "", a[1] or 0.0))[-n:]

    class Pool(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.answers = handle.getListState("answers", part)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            new, fresh = [], 0
            for r in rows:
                fresh += r.weight
                new.append((r.answer, r.reward, r.arrival))
                if len(new) > 2 * n:  # a hot question sends `n` rows for each batch of its uploads
                    new = newest(new)
            new, old, received = newest(new), [], fresh
            for *several, came in self.answers.get():
                old += zip(*several)
                received += came
            pool = newest(old + new)
            columns = list(map(list, zip(*pool)))
            if len(old) + len(new) > 2 * n:
                self.answers.put([(*columns, received)])
            else:
                self.answers.appendValue((*map(list, zip(*new)), fresh))
            answers, rewards, arrivals = columns
            yield Row(q=key[0], answers=answers, rewards=rewards, arrivals=arrivals, received=received, fresh=fresh)

        def close(self) -> None:
            pass

    return Pool()


def question_pool(uploads: DataFrame, n: int = POOL_SIZE) -> DataFrame:
    """The newest `n` answers of each question, emitted for the questions a trigger changed.

    State holds at most twice `n` answers per question. A hot question is cut on the map side first, so
    its key never receives more than `n` rows per Arrow batch. Needs the state store of `listed_state`.
    """
    rows = uploads.select("q", "answer", F.col("reward").cast("double"), F.col("arrival").cast("bigint"))
    slim = T.StructType(list(rows.schema.fields)).add("weight", "long")
    return rows.mapInPandas(_newest_per_question(n), slim).groupBy("q").transformWithState(_processor(n), POOL, "Update", "None")


@contextmanager
def listed_state(spark: SparkSession):
    """Queries started inside keep lists in their state; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def pool_rows(pool: DataFrame) -> DataFrame:
    """Pool rows back to one row per answer."""
    zipped = F.arrays_zip(
        F.col("answers").alias("answer"), F.col("rewards").alias("reward"), F.col("arrivals").alias("arrival")
    )
    return pool.select("q", F.inline(zipped))


def _state(spark: SparkSession, checkpoint: str, variable: str, trigger: int | None) -> DataFrame:
    reader = spark.read.format("statestore").option("stateVarName", variable)
    if trigger is not None:
        reader = reader.option("batchId", trigger)
    return reader.load(checkpoint)


def pooled_answers(spark: SparkSession, checkpoint: str, n: int = POOL_SIZE, trigger: int | None = None) -> DataFrame:
    """The newest `n` answers of every question after a trigger, the last one by default.

    Read from the state itself, each question where it lies; one row per answer.
    """
    rows = _state(spark, checkpoint, "answers", trigger)
    return keep_last(pool_rows(rows.select("key.q", "list_element.*")), n)


def received_answers(spark: SparkSession, checkpoint: str, trigger: int | None = None) -> DataFrame:
    """How many answers of each question came in up to a trigger, the last one by default."""
    rows = _state(spark, checkpoint, "answers", trigger)
    return rows.groupBy("key.q").agg(F.sum("list_element.received").alias("received"))


def _started(stream: DataFrame, sink, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    with listed_state(stream.sparkSession):
        return (
            stream.writeStream.foreachBatch(sink)
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def pool_stream(uploads: DataFrame, checkpoint: str, n: int = POOL_SIZE, trigger: dict | None = None) -> StreamingQuery:
    """Keep the pools of an upload stream; `pooled_answers` and `received_answers` read them."""
    def drained(changed: DataFrame, batch_id: int) -> None:
        changed.write.format("noop").mode("overwrite").save()

    return _started(question_pool(uploads, n), drained, checkpoint, trigger)


def regroup_stream(
    uploads: DataFrame, path: str, checkpoint: str, min_total: int = MIN_TOTAL, size: int = DRAW_SIZE,
    n: int = POOL_SIZE, seed: int = 0, tol: float = POOL_TOLERANCE, trigger: dict | None = None,
) -> StreamingQuery:
    """Groups of `size` answers from every question's pool on each trigger, once `min_total` answers came in.

    A trigger draws from the pools it changed as it emits them, and from all others as the state of the
    trigger before holds them, so a pool that no longer changes is drawn again and again. The gate counts
    all answers in the same way. Every trigger writes its own folder below `groups` with overwrite, and the state of an
    earlier trigger does not change, so a repeated trigger gives the same groups.
    """
    def emit(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        here = changed.persist()  # the stateful step must run once; a lost block is computed from the same state
        try:
            total = here.agg(F.coalesce(F.sum("fresh"), F.lit(0))).first()[0]
            pools = pool_rows(here)
            if batch_id:
                before = received_answers(spark, checkpoint, batch_id - 1)
                total += before.agg(F.coalesce(F.sum("received"), F.lit(0))).first()[0]
                others = pooled_answers(spark, checkpoint, n, batch_id - 1).join(here.select("q"), "q", "left_anti")
                pools = pools.unionByName(others)
            if total >= min_total:
                groups = regroup(pools, size, f"{seed}:{batch_id}", tol)
                groups.write.mode("overwrite").parquet(f"{path}/groups/batch={batch_id}")
        finally:
            here.unpersist()

    return _started(question_pool(uploads, n), emit, checkpoint, trigger)
