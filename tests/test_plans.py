"""Physical plans: what is pushed down, pruned, shuffled and reused."""

import pytest
from pyspark.sql import functions as F

from rollmill.catalog import views as V
from rollmill.operators import batching as B
from rollmill.operators import tokens as K
from rollmill.plans import grpo
from rollmill.session import run_dir
from rollmill.sources import batches, datasets


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_splits_are_pruned(spark, sf):
    path = run_dir(spark, "pruned")
    rows = V.graded(spark, sf).select(
        F.col("doc_id").alias("idx"), F.col("answer").alias("question"), F.col("answer_raw").alias("answer"),
        F.when(F.col("correct"), "train").otherwise("test").alias("split"),
    )
    datasets.write_dataset(rows, path)
    only = datasets.read_questions(spark, path, "test").select("idx", "gold")
    text = plan(only)
    assert "PartitionFilters: [isnotnull(split" in text
    assert "ReadSchema: struct<answer:string,idx:bigint>" in text


def test_bucketed_tokens_align_without_a_shuffle(spark, sf, no_broadcast):
    rows = V.tokens(spark, sf)
    names = []
    for c in ("logp", "gen_logp", "ref_logp"):
        names.append(f"tokens_{c}")
        batches.write_token_table(rows.select("rollout_id", "pos", c), names[-1], 4, mode="overwrite")
    joined = K.align_logps(*[spark.table(n) for n in names])
    assert "Exchange" not in plan(joined)
    assert joined.count() == rows.count()


def test_pool_is_cut_before_the_shuffle(spark, sf):
    text = plan(B.keep_last(V.uploads(spark, sf)))
    assert text.index("Exchange") < text.index("row_number(), 100, Partial")


def test_scores_are_taken_before_the_join(spark, sf, no_broadcast):
    scored = grpo.score_rollouts(
        V.rollouts(spark, sf).select("q_id", "line", "answer"), V.questions(spark, sf).select("q_id", "gold")
    ).select("q_id", "line", "reward")
    assert "SortMergeJoin" in plan(scored)
    for line in plan(scored).splitlines():
        if "Exchange hashpartitioning" in line:
            assert "answer" not in line


def test_statistics_are_computed_once(spark, sf, no_broadcast):
    from rollmill.operators.groups import group_advantage

    done = group_advantage(V.rollouts(spark, sf), spread=V.ROLLOUT_ID, hot_rows=5)
    done.toArrow()
    assert "ReusedExchange" in plan(done)


def test_logsumexp_sums_before_the_shuffle(spark, sf):
    rows = spark.range(1000).select((F.col("id") % 7).alias("pos"), F.rand(1).alias("logit"))
    text = plan(K.logsumexp(rows, ["pos"]))
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2
    # reading upwards: partial sums first, and what is shuffled is a group, a multiple and its sum
    assert "partial_sum(" in text[text.rindex("Exchange hashpartitioning"):]
    assert "logit" not in "".join(exchanges)


def test_rarity_reads_its_rows_twice(spark, sf):
    from rollmill.operators.groups import rarity

    path = run_dir(spark, "rarity-rows")
    V.rollouts(spark, sf).select("q_id", "line", "reward").write.parquet(path)
    done = rarity(spark.read.parquet(path), spread=["line"])
    initial = done._jdf.queryExecution().sparkPlan().toString()
    assert initial.count("rarity-rows") <= 2  # one to join, one to count hot levels; the first pass is stored


def test_token_advantages_read_their_rows_once_more(spark, sf):
    from rollmill.plans.reinforce import rfpp_advantage_tokens

    path = run_dir(spark, "token-rows")
    V.tokens(spark, sf).write.parquet(path)
    initial = rfpp_advantage_tokens(spark.read.parquet(path))._jdf.queryExecution()
    assert initial.sparkPlan().toString().count("token-rows") == 1  # the moments are a stored table
    shuffles = [line for line in initial.executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert sum("rollout_id" in line for line in shuffles) == 1
