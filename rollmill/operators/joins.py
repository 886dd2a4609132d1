"""Joins between questions, answers, token sequences and reference log-probs.

None of them broadcasts a side that grows with the data: the choice is left to Spark's own size check.
Joins by question go through `skew.join_lookup`, since one question may have very many answers; joins
by answer or token have unique keys on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollmill.operators.prompts import expand_tests
from rollmill.operators.skew import HOT_ROWS, join_lookup

__all__ = [
    "attach_questions",
    "enrich_with_ref",
    "expand_tests",
    "merge_sequences",
    "retry_accuracy",
    "retry_candidates",
    "unattempted",
]


def attach_questions(
    rollouts: DataFrame, questions: DataFrame, on: Sequence[str] = ("q_id",), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every answer with the columns of its question."""
    return join_lookup(rollouts, questions, on, hot_rows=hot_rows)


def merge_sequences(
    prompts: DataFrame, completions: DataFrame, on: Sequence[str] = ("q_id",),
    prompt_ids: str = "prompt_ids", completion_ids: str = "completion_ids",
) -> DataFrame:
    """Prompt ids in front of every completion of the question, with the prompt length."""
    joined = join_lookup(completions, prompts.select(*on, prompt_ids), on)
    return joined.withColumns(
        {"plen": F.size(prompt_ids), "input_ids": F.concat(prompt_ids, completion_ids)}
    ).drop(prompt_ids, completion_ids)


def retry_candidates(questions: DataFrame, graded: DataFrame, on: Sequence[str] = ("q_id",), correct: str = "correct") -> DataFrame:
    """Questions whose first answers failed."""
    return questions.join(graded.where(~F.col(correct)).select(*on).distinct(), list(on), "left_semi")


def unattempted(questions: DataFrame, graded: DataFrame, on: Sequence[str] = ("q_id",)) -> DataFrame:
    """Questions without any graded answer."""
    return questions.join(graded.select(*on).distinct(), list(on), "left_anti")


def retry_accuracy(first: DataFrame, retry: DataFrame, on: Sequence[str] = ("q_id",), correct: str = "correct") -> DataFrame:
    """Share of all first-pass questions that only their retry got right."""
    after = retry.groupBy(*on).agg(F.bool_or(correct).alias("_retry"))
    before = first.groupBy(*on).agg(F.bool_or(correct).alias("_first"))
    rescued = F.coalesce(~F.col("_first") & F.col("_retry"), F.lit(False)).cast("int")
    n = F.count(F.lit(1))
    return before.join(after, list(on), "left").agg(
        n.alias("questions"),
        F.sum(rescued).alias("retry_correct"),
        F.coalesce(F.try_divide(F.sum(rescued), n), F.lit(0.0)).alias("retry_accuracy"),
    )


def enrich_with_ref(rollouts: DataFrame, ref: DataFrame, on: Sequence[str] = ("rollout_id",)) -> DataFrame:
    """Answers with their reference log-probs; `rollouts` may be a stream, `ref` a table."""
    return rollouts.join(ref, list(on))
