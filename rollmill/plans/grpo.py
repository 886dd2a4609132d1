"""From answers to group-relative advantages and training batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.functions.rewards import sum_reward
from rollmill.functions.text import SEP_LOOSE, last_number, math_equal, think_format_strict
from rollmill.operators.batching import micro_batches
from rollmill.operators.groups import informative_advantage
from rollmill.operators.joins import attach_questions
from rollmill.operators.skew import HOT_ROWS
from rollmill.session import written


def score_rollouts(
    rollouts: DataFrame, questions: DataFrame, sep: str = SEP_LOOSE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Answers joined to their questions, graded for correctness and format.

    Number and format are taken before the join, so a caller who drops the answers keeps whole texts
    out of the shuffle.
    """
    extracted = rollouts.withColumns(
        {"number": last_number("answer"), "format_ok": think_format_strict("answer", sep)}
    )
    graded = attach_questions(extracted, questions, hot_rows=hot_rows).withColumn(
        "correct", F.coalesce(math_equal("number", "gold"), F.lit(False))
    )
    return graded.withColumn("reward", sum_reward("correct", "format_ok")).drop("number")


def grpo_advantages(rollouts: DataFrame, questions: DataFrame, sep: str = SEP_LOOSE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Score every answer, drop groups without a signal, normalise within the group.

    Group statistics and the rows they go to both need the scores, so these are written once: three
    narrow columns in place of a second pass over the answer texts.
    """
    scored = score_rollouts(rollouts, questions, sep, hot_rows).select("q_id", "rollout_idx", "reward")
    return informative_advantage(written(scored, "scored"), hot_rows=hot_rows)


def grpo_batches(rollouts: DataFrame, questions: DataFrame, size: int = 8, sep: str = SEP_LOOSE) -> DataFrame:
    """Advantages cut into micro batches of `size` answers of one question."""
    return micro_batches(grpo_advantages(rollouts, questions, sep), size)


def batch_messages(rows: DataFrame, pad_id: int, batch: tuple[str, ...] = ("q_id", "micro_batch")) -> DataFrame:
    """One row per batch, ids padded to the longest answer of the batch.

    `rows` come from `micro_batches` with prompt and answer ids; a batch has a fixed number of rows.
    """
    row = F.struct("rollout_idx", "prompt_ids", "answer_ids", "advantage")
    packed = rows.groupBy(*batch).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    longest = F.array_max(F.transform("_rows", lambda r: F.size(r["answer_ids"])))

    def merged(r):
        filler = F.array_repeat(F.lit(pad_id), F.col("_longest") - F.size(r["answer_ids"]))
        return F.concat(r["prompt_ids"], r["answer_ids"], filler)

    return packed.withColumn("_longest", longest).select(
        *batch,
        F.size(F.col("_rows")[0]["prompt_ids"]).alias("plen"),
        F.transform("_rows", merged).alias("inputs"),
        F.transform("_rows", lambda r: r["advantage"]).alias("rewards"),
    )
