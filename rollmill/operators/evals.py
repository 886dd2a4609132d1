"""Evaluation metrics over graded answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.operators.scan import BUCKET_WIDTH, totals_by_ranges
from rollmill.session import written

PASS_KS = tuple(2**i for i in range(10))
PREFIXES = (1, 3, 5)
LEVELS = (1, 2, 3, 4, 5)


def _share(total: Column, n: Column) -> Column:
    """total / n, zero for empty input."""
    return F.coalesce(F.try_divide(total.cast("double"), n), F.lit(0.0))


def _as_number(flag: str) -> Column:
    return F.col(flag).cast("int")


def eval_summary(df: DataFrame, correct: str = "correct", loose: str = "format_ok", strict: str = "format_strict") -> DataFrame:
    """Sample count, accuracy, format rate and strict format rate in one row."""
    n = F.count(F.lit(1))
    rates = {"accuracy": correct, "format_rate": loose, "format_rate_strict": strict}
    return df.agg(
        n.alias("samples"), *[_share(F.sum(_as_number(c)), n).alias(name) for name, c in rates.items()]
    )


def length_by_outcome(df: DataFrame, length: str = "n_words", correct: str = "correct") -> DataFrame:
    """Mean length of all, right and wrong answers; NULL where there are none."""
    size, ok = F.col(length), F.col(correct)
    return df.agg(
        F.avg(size).alias("avg_words"),
        F.avg(F.when(ok, size)).alias("avg_corr_ans_words"),
        F.avg(F.when(~ok, size)).alias("avg_err_ans_words"),
    )


def accuracy_by_level(df: DataFrame, levels: Sequence[int] = LEVELS, level: str = "level", correct: str = "correct") -> DataFrame:
    """Accuracy and count per level, listed levels filled with zeros; level NULL is the overall row."""
    spark = df.sparkSession
    seen = (
        df.rollup(level)
        .agg(F.grouping(level).alias("_all"), F.count(F.lit(1)).alias("n"), F.sum(_as_number(correct)).alias("right"))
        .select(F.col(level).cast("int").alias("level"), "_all", "n", "right")
    )
    zeros = spark.range(1).select(
        F.explode(F.array(*[F.lit(v) for v in levels])).alias("level"),
        F.lit(0).cast(seen.schema["_all"].dataType).alias("_all"),
        F.lit(0).cast("bigint").alias("n"),
        F.lit(0).cast("bigint").alias("right"),
    )
    return (
        seen.unionByName(zeros)
        .groupBy("_all", "level")
        .agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
        .select("level", "n", _share(F.col("right"), F.col("n")).alias("accuracy"))
    )


def pass_probability(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n-c,k)/C(n,k) as a product of k factors, whatever the number of answers."""
    def factor(miss: Column, j: Column) -> Column:
        return miss * F.greatest(n - c - j, F.lit(0)) / (n - j)

    return 1 - F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint") - 1), F.lit(1.0), factor)


def question_counts(df: DataFrame, by: Sequence[str] = ("q_id",), correct: str = "correct") -> DataFrame:
    """Answers and right answers per question."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_as_number(correct).cast("bigint")).alias("c")
    )


def _pass_rows(counts: DataFrame, ks: Sequence[int], inclusive: bool) -> DataFrame:
    k = F.explode(F.array(*[F.lit(v) for v in ks])).alias("k")
    rows = counts.select("*", k)
    return rows.where(F.col("k") <= F.col("n") if inclusive else F.col("k") < F.col("n")).withColumn(
        "score", pass_probability(F.col("n"), F.col("c"), F.col("k"))
    )


def pass_at_k(
    df: DataFrame, ks: Sequence[int] = PASS_KS, inclusive: bool = False, by: Sequence[str] = ("q_id",),
    correct: str = "correct",
) -> DataFrame:
    """Unbiased pass@k, averaged over the questions with more (`inclusive`: at least) `k` answers."""
    rows = _pass_rows(question_counts(df, by, correct), ks, inclusive)
    return rows.groupBy("k").agg(F.avg("score").alias("pass_at_k"), F.count(F.lit(1)).alias("questions"))


def any_correct(df: DataFrame, by: Sequence[str] = ("q_id",), correct: str = "correct", loose: str = "format_ok") -> DataFrame:
    """A question counts when any answer is right; its format counts as the mean over its answers."""
    per_question = df.groupBy(*by).agg(
        F.bool_or(correct).alias("any"), F.avg(_as_number(loose)).alias("fmt")
    )
    n = F.count(F.lit(1))
    return per_question.agg(
        n.alias("questions"),
        _share(F.sum(F.col("any").cast("int")), n).alias("accuracy"),
        _share(F.sum("fmt"), n).alias("format_rate"),
    )


def mean_correct(df: DataFrame, by: Sequence[str] = ("q_id",), correct: str = "correct", loose: str = "format_ok") -> DataFrame:
    """Each answer earns its question an equal part of one credit."""
    per_question = df.groupBy(*by).agg(
        F.avg(_as_number(correct)).alias("credit"), F.avg(_as_number(loose)).alias("fmt")
    )
    n = F.count(F.lit(1))
    return per_question.agg(
        n.alias("questions"),
        _share(F.sum("credit"), n).alias("accuracy"),
        _share(F.sum("fmt"), n).alias("format_rate"),
    )


def prefix_success(
    df: DataFrame, ps: Sequence[int] = PREFIXES, by: Sequence[str] = ("q_id",), passed: str = "passed",
    order: str = "rollout_idx",
) -> DataFrame:
    """Share of questions solved by one of their first `p` answers, for each `p`."""
    solved = [F.bool_or(F.col(passed) & (F.col(order) < p)).alias(f"_{p}") for p in ps]
    per_question = df.groupBy(*by).agg(*solved)
    n = F.count(F.lit(1))
    return per_question.agg(
        n.alias("questions"), *[_share(F.sum(F.col(f"_{p}").cast("int")), n).alias(f"ps{p}") for p in ps]
    )


def outcome_summary(df: DataFrame, by: Sequence[str] = ("q_id", "rollout_idx"), status: str = "status") -> DataFrame:
    """Passed and total tests of each code answer, and whether all of them passed."""
    passed = F.count_if(F.col(status) == "passed")
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        passed.alias("num_passed"), n.alias("total_tests"), (passed == n).alias("passed")
    )


def test_status(exit_ok: Column, stdout: Column) -> Column:
    """Status of one test run from its exit flag and its output."""
    return (
        F.when(~exit_ok, "error").when(F.contains(stdout, F.lit("TEST_PASSED")), "passed").otherwise("failed")
    )


def code_reward(df: DataFrame, by: Sequence[str] = ("q_id", "rollout_idx"), status: str = "status") -> DataFrame:
    """Share of passed tests plus share of tests that ran without an error."""
    passed = F.avg((F.col(status) == "passed").cast("int"))
    ran = F.avg((F.col(status) != "error").cast("int"))
    return df.groupBy(*by).agg((passed + ran).alias("correct_reward"))


def total_pass_rate(df: DataFrame, by: Sequence[str] = ("q_id",), rollout: str = "rollout_idx", status: str = "status") -> DataFrame:
    """Pass shares summed over all answers, divided by the number of questions (so it can pass one)."""
    per_answer = outcome_summary(df, [*by, rollout], status)
    share = F.col("num_passed") / F.col("total_tests")
    per_question = per_answer.groupBy(*by).agg(F.sum(share).alias("_share"))
    n = F.count(F.lit(1))
    return per_question.agg(n.alias("questions"), _share(F.sum("_share"), n).alias("total_pass_rate"))


def group_scores(df: DataFrame, by: Sequence[str] = ("q_id",), acc: str = "acc_score", fmt: str = "format_score") -> DataFrame:
    """Per question, how many answers score above zero for accuracy and for format."""
    return df.groupBy(*by).agg(
        F.count_if(F.col(acc) > 0).alias("n_correct"), F.count_if(F.col(fmt) > 0).alias("n_format")
    )


def timing_summary(df: DataFrame, seconds: str = "seconds") -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(
        F.coalesce(F.sum(seconds), F.lit(0.0)).alias("elapsed_time_sec"),
        n.alias("samples"),
        _share(F.sum(seconds), n).alias("time_per_sample_sec"),
    )


def running_eval(
    df: DataFrame, ks: Sequence[int] = (1, 2, 4, 8), ps: Sequence[int] = PREFIXES, q: str = "q_idx",
    correct: str = "correct", order: str = "rollout_idx", parts: int | None = None,
) -> DataFrame:
    """Progress after each question in dataset order: solved so far, pass@k and prefix success so far."""
    per_question = df.groupBy(q).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(_as_number(correct).cast("bigint")).alias("c"),
        F.bool_or(correct).alias("_any"),
        *[F.bool_or(F.col(correct) & (F.col(order) < p)).alias(f"_ps{p}") for p in ps],
    )
    totals = {
        "questions": F.lit(1).cast("bigint"),
        "solved": F.col("_any").cast("bigint"),
        **{
            f"pass_at_{k}": F.when(
                F.col("n") >= k, pass_probability(F.col("n"), F.col("c"), F.lit(k))
            ).otherwise(F.lit(0.0))
            for k in ks
        },
        **{f"ps{p}": F.col(f"_ps{p}").cast("double") for p in ps},
    }
    so_far = totals_by_ranges(per_question, [], [q], totals, parts)
    rates = [f"pass_at_{k}" for k in ks] + [f"ps{p}" for p in ps]
    return so_far.select(
        q, "questions", "solved", *[(F.col(r) / F.col("questions")).alias(r) for r in rates]
    )


def running_training(
    df: DataFrame, step: str = "step", rows: str = "n_sequences", padded: str = "padded_length",
    acc: str = "n_correct", fmt: str = "n_format", parts: int | None = None,
) -> DataFrame:
    """Training metrics after each step: mean padded length, right and well-formed shares so far.

    The input has one row per step with its number of sequences and its padded length.
    """
    totals = {
        "_rows": F.col(rows).cast("bigint"),
        "_tokens": (F.col(rows) * F.col(padded)).cast("bigint"),
        "_acc": F.col(acc).cast("bigint"),
        "_fmt": F.col(fmt).cast("bigint"),
    }
    so_far = totals_by_ranges(df, [], [step], totals, parts)
    return so_far.select(
        step,
        F.try_divide("_tokens", "_rows").alias("avg_output_token_length"),
        F.try_divide("_acc", "_rows").alias("acc_correct_ratio"),
        F.try_divide("_fmt", "_rows").alias("format_correct_ratio"),
    )


def eval_detail(df: DataFrame, idx: str = "idx", correct: str = "correct", part_size: int = BUCKET_WIDTH) -> DataFrame:
    """Indexes answered right and the accuracy, `part_size` indexes to a row; `logs.write_eval_detail` makes one record of them.

    Small evaluations give one row; a large one is cut into parts instead of one list in one task. No
    answers give one row with an empty list and zeros. The graded rows are read once.
    """
    marks = written(df.select(F.col(idx).alias("_idx"), F.col(correct).alias("_ok")), "marks")
    totals = marks.agg(_share(F.sum(_as_number("_ok")), F.count(F.lit(1))).alias("acc"), F.count(F.lit(1)).alias("num_samples"))
    right = F.sort_array(F.collect_list(F.when(F.col("_ok"), F.col("_idx"))))
    parts = marks.groupBy(F.floor(F.col("_idx") / part_size).alias("part")).agg(right.alias("correct"))
    accuracy, total = totals.select("acc").scalar(), totals.select("num_samples").scalar()
    rows = parts.select("part", "correct", accuracy.alias("acc"), total.alias("num_samples"))
    none = totals.where(F.col("num_samples") == 0).select(
        F.lit(0).cast("bigint").alias("part"), F.array().cast(rows.schema["correct"].dataType).alias("correct"), "acc", "num_samples"
    )
    return rows.unionByName(none)
