import math

import pytest
from pyspark.sql import functions as F

from rollmill.operators import evals as E
from rollmill.operators import prompts as P
from rollmill.functions import rewards as R


def answers(spark, groups):
    rows = [(q, i, bool(c)) for q, marks in groups.items() for i, c in enumerate(marks)]
    return spark.createDataFrame(rows, "q_id string, rollout_idx int, correct boolean").withColumn("format_ok", F.lit(True))


def test_pass_at_k_by_binomials(spark):
    groups = {f"{n}-{c}": [1] * c + [0] * (n - c) for n in (1, 2, 5, 16, 40) for c in range(0, n + 1, 3)}
    df = answers(spark, groups)
    for inclusive in (False, True):
        got = {r.k: r.pass_at_k for r in E.pass_at_k(df, inclusive=inclusive).collect()}
        for k in E.PASS_KS:
            scores = [
                1 - math.comb(len(m) - sum(m), k) / math.comb(len(m), k)
                for m in groups.values()
                if (k <= len(m) if inclusive else k < len(m))
            ]
            assert (k in got) == bool(scores)
            if scores:
                assert got[k] == pytest.approx(sum(scores) / len(scores))
        values = [got[k] for k in sorted(got)]
        assert len(values) > 3


def test_pass_at_one_is_the_share_and_grows_with_k(spark):
    df = answers(spark, {"a": [1, 0, 0, 0] * 4})
    got = {r.k: r.pass_at_k for r in E.pass_at_k(df).collect()}
    assert got[1] == pytest.approx(0.25)
    assert [got[k] for k in sorted(got)] == sorted(got.values())
    four = {r.k: r.pass_at_k for r in E.pass_at_k(answers(spark, {"a": [1, 0, 0, 0]})).collect()}
    assert four == {1: pytest.approx(0.25), 2: pytest.approx(0.5)}


def test_pass_at_k_needs_no_long_arrays(spark):
    n = F.lit(10**9).cast("bigint")
    row = spark.range(1).select(E.pass_probability(n, (n / 2).cast("bigint"), F.lit(512)).alias("v")).first()
    assert row.v == pytest.approx(1.0)


def test_empty_input_gives_zero_rates(spark):
    none = spark.createDataFrame([], "q_id string, rollout_idx int, correct boolean, format_ok boolean, format_strict boolean, n_words int, level int")
    row = E.eval_summary(none).first()
    assert (row.samples, row.accuracy, row.format_rate, row.format_rate_strict) == (0, 0.0, 0.0, 0.0)
    assert E.length_by_outcome(none).first().avg_words is None
    assert E.any_correct(none).first().accuracy == 0.0
    levels = {r.level: (r.n, r.accuracy) for r in E.accuracy_by_level(none).collect()}
    assert {k: v for k, v in levels.items() if k} == {v: (0, 0.0) for v in range(1, 6)}


def test_prefix_success_grows(spark):
    df = answers(spark, {"a": [0, 0, 1], "b": [1], "c": [0] * 6, "d": [0, 0, 0, 0, 1, 1]}).withColumnRenamed("correct", "passed")
    row = E.prefix_success(df).first()
    assert (row.questions, row.ps1, row.ps3, row.ps5) == (4, 0.25, 0.5, 0.75)


def outcomes(spark, statuses):
    rows = [(q, r, t, s) for (q, r), tests in statuses.items() for t, s in enumerate(tests)]
    return spark.createDataFrame(rows, "q_id int, rollout_idx int, test_case int, status string")


def test_code_metrics(spark):
    df = outcomes(spark, {(1, 0): ["passed", "failed", "error", "passed"], (1, 1): ["passed"] * 3})
    got = {r.rollout_idx: (r.num_passed, r.total_tests, r.passed) for r in E.outcome_summary(df).collect()}
    assert got == {0: (2, 4, False), 1: (3, 3, True)}
    assert {r.rollout_idx: r.correct_reward for r in E.code_reward(df).collect()} == {0: 1.25, 1: 2.0}
    both = outcomes(spark, {(1, 0): ["passed"] * 2, (1, 1): ["passed"] * 3})
    assert E.total_pass_rate(both).first().total_pass_rate == 2.0


def test_running_eval_ends_at_the_totals(spark):
    groups = {q: [int((q + i) % 3 == 0) for i in range(4)] for q in range(50)}
    rows = [(q, i, bool(c)) for q, marks in groups.items() for i, c in enumerate(marks)]
    df = spark.createDataFrame(rows, "q_idx long, rollout_idx int, correct boolean")
    last = E.running_eval(df, ks=(1, 2), parts=7).orderBy(F.desc("q_idx")).first()
    assert last.questions == 50 and last.solved == sum(any(m) for m in groups.values())
    want = sum(1 - math.comb(4 - sum(m), 2) / math.comb(4, 2) for m in groups.values()) / 50
    assert last.pass_at_2 == pytest.approx(want)


def test_eval_detail_parts(spark):
    df = spark.range(10).select(F.col("id").alias("idx"), (F.col("id") % 2 == 0).alias("correct"))
    whole = E.eval_detail(df).first()
    assert (whole.correct, whole.acc, whole.num_samples) == ([0, 2, 4, 6, 8], 0.5, 10)
    parts = sorted((r.part, r.correct) for r in E.eval_detail(df, part_size=4).collect())
    assert parts == [(0, [0, 2]), (1, [4, 6]), (2, [8])]


def test_rewards(spark):
    flags = spark.createDataFrame([(c, f) for c in (True, False) for f in (True, False)], "c boolean, f boolean")
    rows = flags.select("c", "f", R.sum_reward("c", "f").alias("s"), R.tier_reward("c", "f").alias("t")).collect()
    assert {(r.c, r.f): (r.s, r.t) for r in rows} == {
        (True, True): (2.25, 2.0), (True, False): (0.0, -2.0), (False, True): (0.25, 0.5), (False, False): (-2.0, -2.0)
    }
    for version, want in ((15, -0.8), (16, 1.1)):
        made = R.scheduled_reward(F.lit(1.0), F.lit(-1.0), F.lit(0.1), F.lit(version))
        assert spark.range(1).select(made.alias("v")).first().v == pytest.approx(want)


def test_reward_set_takes_a_pandas_udf(spark):
    import pandas as pd

    @F.pandas_udf("double")
    def short(answer: pd.Series, gold: pd.Series) -> pd.Series:
        return (answer.str.len() < 3).astype(float)

    rewards = R.RewardSet().register_reward("short", short, 2.0)
    with pytest.raises(ValueError):
        rewards.register_reward("short", short)
    df = spark.createDataFrame([("ab", "1"), ("abc", "1")], "answer string, gold string")
    assert [r.reward for r in rewards.apply(df).collect()] == [2.0, 0.0]


def test_python_list_display(spark):
    items = ["plain", "it's", 'say "x"', "it's \"x\"", "back\\slash", "a\nb\tc"]
    df = spark.createDataFrame([(items,)], "tests array<string>")
    assert df.select(P.python_list("tests").alias("v")).first().v == str(items)


def test_programs_run_as_intended(spark):
    tasks = [("def f(x):\n    return x", ["assert f(1) == 1", "assert f(1) == 2", "f(1)"], " ")]
    df = spark.createDataFrame(tasks, "code string, test_list array<string>, test_setup_code string")
    programs = [r.program for r in P.build_test_programs(df).orderBy("test_case").collect()]
    assert programs[0].startswith("def f(x)")
    shown = []
    for program in programs:
        lines = []
        exec(program, {"print": lambda *a: lines.append(" ".join(map(str, a)))})
        shown.append(lines[0])
    assert shown[0] == "TEST_PASSED" and shown[1].startswith("TEST_FAILED") and shown[2].startswith("TEST_RESULT")
