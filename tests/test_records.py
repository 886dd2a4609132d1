"""Saved records of any length, evaluations with several answers, training batches of draws."""

import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rollmill.plans import evaluation
from rollmill.plans import regroup as plan
from rollmill.session import run_dir
from rollmill.sources import logs

SCHEMA = "q_idx long, question string, gold string, rollout_idx long, answer string, correct boolean, format_ok boolean, format_strict boolean"


def answers(spark, sizes):
    rows = [(q, f'what "{q}"?\n', None if q == 2 else str(q), i, f"a{i}\n", i % 2 == 0, True, False) for q, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def lines(path):
    """The lines of all files, as any reader of JSON lines sees them."""
    return [json.loads(t) for p in Path(path).glob("part-*") for t in p.read_text().split("\n") if t.strip()]


def test_one_record_per_question_whatever_its_answers(spark):
    path = run_dir(spark, "records")
    sizes = {1: 3, 2: 1, 3: 9000, 5: 4, 9: 2}
    logs.write_rollouts(answers(spark, sizes).repartition(7), path, 4)
    got = {r["q_idx"]: r for r in lines(path)}
    assert len(lines(path)) == 4 and set(got) == {1, 2, 3, 5}
    for q, r in got.items():
        assert [a["rollout_idx"] for a in r["results"]] == list(range(sizes[q]))
        assert r["question"] == f'what "{q}"?\n' and r["results"][0] == {
            "rollout_idx": 0, "answer": "a0\n", "correct_reward": 1.0, "format_reward": 1.25, "format_reward_strict": -1.0
        }
    assert got[2]["gold"] is None and got[2]["pass_at_k"] == {}
    assert set(got[1]["pass_at_k"]) == {"1", "2"} and got[1]["pass_at_k"]["1"] == pytest.approx(2 / 3)
    assert got[5]["pass_at_k"]["1"] == pytest.approx((2 / 3 + 1 + 0.5 + 0.5) / 4)
    assert {r.n for r in spark.read.json(path).select(F.size("results").alias("n")).collect()} == {3, 1, 9000, 4}


def test_records_of_none_and_without_a_question(spark):
    rows = answers(spark, {1: 2, 4: 1})
    lost = rows.withColumn("q_idx", F.when(F.col("q_idx") == 1, F.lit(None)).otherwise(F.col("q_idx")))
    for df, want in ((rows.limit(0), []), (lost, [4])):
        path = run_dir(spark, "few-records")
        logs.write_rollouts(df, path, 3, ks=())
        assert [r["q_idx"] for r in lines(path)] == want


@pytest.mark.parametrize("n", [0, 1, 10, 1000])
def test_one_detail_record(spark, n):
    path = run_dir(spark, "detail-test")
    df = spark.range(n).select((F.col("id") * 3).alias("idx"), (F.col("id") % 5 == 1).alias("correct"))
    logs.write_eval_detail(df, path, part_size=7)
    right = [3 * i for i in range(n) if i % 5 == 1]
    assert lines(path) == [{"correct": right, "acc": len(right) / n if n else 0.0, "num_samples": n}]


def test_several_answers_to_a_question(spark):
    marks = {q: [(q + i) % 3 == 0 for i in range(2 + q % 4)] for q in range(30)}
    rows = [(q, f"<think>t</think><answer>{q if m else q + 1}</answer>" + " w" * i) for q, ms in marks.items() for i, m in enumerate(ms)]
    golds = spark.createDataFrame([(q, str(q)) for q in marks], "q_id long, gold string")
    got = evaluation.evaluate_samples(spark.createDataFrame(rows, "q_id long, answer string"), golds).first()
    assert (got.samples, got.answers) == (30, sum(map(len, marks.values())))
    assert got.accuracy == pytest.approx(sum(map(any, marks.values())) / 30)
    assert set(got.pass_at_k) == {1, 2, 4}
    for k, score in got.pass_at_k.items():
        want = [1 - math.comb(len(m) - sum(m), k) / math.comb(len(m), k) if len(m) >= k else 0 for m in marks.values()]
        assert score == pytest.approx(sum(want) / 30)
    none = evaluation.evaluate_samples(spark.createDataFrame([], "q_id long, answer string"), golds).first()
    assert (none.samples, none.answers, none.accuracy) == (0, 0, 0.0)


def test_draws_become_training_batches(spark):
    rows = [("q", i, float(i % 2), [1, 2], list(range(3 + i))) for i in range(8)] + [("few", 9, 1.0, [1], [1])]
    up = spark.createDataFrame(rows, "q string, arrival long, reward double, prompt_ids array<int>, answer_ids array<int>")
    got = sorted(plan.regrouped_batches(up, -1).collect(), key=lambda r: r.micro_batch)
    assert [(r.q, r.micro_batch, r.plen) for r in got] == [("q", 0, 2), ("q", 1, 2)]
    inputs = [x for r in got for x in r.inputs]
    assert inputs == [[1, 2, *range(3 + i), *[-1] * (7 - i)] for i in range(8)]
    assert all(len(r.inputs) == len(r.rewards) == 4 for r in got)
    assert sum(x for r in got for x in r.rewards) == pytest.approx(0)
    with pytest.raises(ValueError):
        plan.regrouped_batches(up, -1, train=3)
