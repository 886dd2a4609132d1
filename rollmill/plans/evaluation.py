"""Whole evaluation runs as one plan each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions.text import (
    last_number,
    math_equal,
    strip,
    think_format,
    think_format_strict,
    with_math_correct,
    word_count,
)
from rollmill.operators.evals import LEVELS, PASS_KS, PREFIXES, outcome_summary, pass_probability
from rollmill.operators.joins import attach_questions


def grade_numeric(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Grade answers against numeric golds, with both format checks and the word count."""
    read = answers.withColumn("answer", strip("answer")).withColumns(
        {
            "number": last_number("answer"),
            "format_ok": think_format("answer"),
            "format_strict": think_format_strict("answer"),
            "n_words": word_count("answer"),
        }
    )
    right = F.coalesce(math_equal("number", "gold"), F.lit(False))
    return attach_questions(read, questions).withColumn("correct", right).drop("number")


def grade_math(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Grade answers against LaTeX golds; the format check is the strict one."""
    read = answers.withColumn("answer", strip("answer"))
    graded = with_math_correct(attach_questions(read, questions))
    return graded.withColumn("format_ok", think_format_strict("answer"))


def evaluate_numeric(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Accuracy, format rates and answer lengths in one row."""
    graded = grade_numeric(answers, questions)
    n = F.count(F.lit(1))
    flags = {"accuracy": "correct", "format_rate": "format_ok", "format_rate_strict": "format_strict"}
    lengths = {
        "avg_words": F.avg("n_words"),
        "avg_corr_ans_words": F.avg(F.when(F.col("correct"), F.col("n_words"))),
        "avg_err_ans_words": F.avg(F.when(~F.col("correct"), F.col("n_words"))),
    }
    return graded.agg(
        n.alias("samples"),
        *[F.coalesce(F.try_divide(F.sum(F.col(c).cast("int")), n), F.lit(0.0)).alias(k) for k, c in flags.items()],
        *[c.alias(k) for k, c in lengths.items()],
    )


def evaluate_samples(answers: DataFrame, questions: DataFrame, ks: Sequence[int] = PASS_KS) -> DataFrame:
    """An evaluation with several answers to a question, in one row.

    A question is right if any of its answers is, its format rates are the means over its answers, and lengths
    are averaged over answers. pass@k is listed for each k below the largest number of answers; a question
    with fewer than k answers adds nothing to it. Answers are counted by question before the shuffle.
    """
    graded = grade_numeric(answers, questions)
    right, words = F.col("correct"), F.col("n_words")
    per_question = graded.groupBy("q_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(right).alias("c"),
        F.avg(F.col("format_ok").cast("int")).alias("_loose"),
        F.avg(F.col("format_strict").cast("int")).alias("_strict"),
        F.sum(words).alias("_words"),
        F.sum(F.when(right, words)).alias("_right_words"),
    )
    n, c, k = F.col("n"), F.col("c"), F.count(F.lit(1))
    passed = [
        x for v in ks for x in (F.lit(v), F.avg(F.when(n >= v, pass_probability(n, c, F.lit(v))).otherwise(F.lit(0.0))))
    ]
    most, total, solved = F.max("n"), F.sum("n"), F.sum("c")

    def mean(x: Column, of: Column) -> Column:
        return F.coalesce(F.try_divide(x.cast("double"), of), F.lit(0.0))

    return per_question.agg(
        k.alias("samples"),
        F.coalesce(total, F.lit(0)).alias("answers"),
        mean(F.count_if(c > 0), k).alias("accuracy"),
        mean(F.sum("_loose"), k).alias("format_rate"),
        mean(F.sum("_strict"), k).alias("format_rate_strict"),
        F.try_divide(F.sum("_words").cast("double"), total).alias("avg_words"),
        F.try_divide(F.sum("_right_words").cast("double"), solved).alias("avg_corr_ans_words"),
        F.try_divide((F.sum("_words") - F.coalesce(F.sum("_right_words"), F.lit(0))).cast("double"), total - solved).alias("avg_err_ans_words"),
        F.create_map(*passed).alias("_passed"), most.alias("_most"),
    ).select("*", F.map_filter("_passed", lambda v, _: v < F.col("_most")).alias("pass_at_k")).drop("_passed", "_most")


def evaluate_math(answers: DataFrame, questions: DataFrame, levels: Sequence[int] = LEVELS) -> DataFrame:
    """Accuracy, format rate and per-level accuracy and counts in one row and one pass."""
    graded = grade_math(answers, questions)
    n = F.count(F.lit(1))

    def share(flag: Column, of: Column) -> Column:
        return F.coalesce(F.try_divide(F.count_if(flag).cast("double"), of), F.lit(0.0))

    right, accuracy, counts = F.col("correct"), [], []
    for v in levels:
        at = F.col("level") == v
        accuracy += [F.lit(v), share(right & at, F.count_if(at))]
        counts += [F.lit(v), F.count_if(at)]
    return graded.agg(
        n.alias("samples"),
        share(right, n).alias("accuracy"),
        share(F.col("format_ok"), n).alias("format_rate"),
        F.create_map(*accuracy).alias("level_accuracy"),
        F.create_map(*counts).alias("level_counts"),
    )


def evaluate_code(outcomes: DataFrame, ps: Sequence[int] = PREFIXES) -> DataFrame:
    """Prefix success per prefix length and total pass rate of code answers, in one row."""
    answers = outcome_summary(outcomes).withColumn("share", F.col("num_passed") / F.col("total_tests"))
    solved = {p: F.bool_or(F.col("passed") & (F.col("rollout_idx") < p)).alias(f"_{p}") for p in ps}
    per_task = answers.groupBy("q_id").agg(F.sum("share").alias("_share"), *solved.values())
    rates = [c for p in ps for c in (F.lit(p), F.coalesce(F.avg(F.col(f"_{p}").cast("int")), F.lit(0.0)))]
    return per_task.agg(
        F.count(F.lit(1)).alias("samples"),
        F.create_map(*rates).alias("pass"),
        F.coalesce(F.avg("_share"), F.lit(0.0)).alias("total_pass_rate"),
    )
