import math
import statistics

import pytest
from pyspark.sql import functions as F

from rollmill.operators import batching as B
from rollmill.operators import groups as G
from rollmill.operators import joins as J
from rollmill.operators import skew
from rollmill.operators.scan import bucket_hot_groups, key_bucket, ranked, running_totals, width_bucket


@pytest.fixture(scope="module")
def lopsided(spark):
    """A third of the rows in question 0, the rest in groups of one to seven."""
    rows = [(0, i, float((i * 7) % 4)) for i in range(400)]
    q, left = 1, 800
    while left > 0:
        n = min(1 + q % 7, left)
        rows += [(q, i, float((i * q) % 3)) for i in range(n)]
        q, left = q + 1, left - n
    return rows, spark.createDataFrame(rows, "q_id long, rollout_idx long, reward double")


def by_group(rows):
    groups = {}
    for q, i, r in rows:
        groups.setdefault(q, []).append((i, r))
    return groups


@pytest.mark.parametrize("hot_rows", [5, 100, 10**6])
def test_advantage_with_hot_groups(lopsided, hot_rows):
    rows, df = lopsided
    expected = {}
    for q, members in by_group(rows).items():
        values = [r for _, r in members]
        for i, r in members:
            expected[q, i] = (
                (r - statistics.mean(values)) / (statistics.stdev(values) + 1e-4) if len(values) > 1 else None
            )
    got = G.group_advantage(df, hot_rows=hot_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        want = expected[r.q_id, r.rollout_idx]
        assert r.advantage is None if want is None else r.advantage == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_flat_filter_and_fused_form(lopsided, hot_rows):
    rows, df = lopsided
    kept = {q for q, m in by_group(rows).items() if max(r for _, r in m) - min(r for _, r in m) >= 1e-4}
    plain = G.drop_flat_groups(df, hot_rows=hot_rows)
    assert {r.q_id for r in plain.collect()} == kept
    two_steps = {(r.q_id, r.rollout_idx): r.advantage for r in G.group_advantage(plain, hot_rows=hot_rows).collect()}
    fused = {(r.q_id, r.rollout_idx): r.advantage for r in G.informative_advantage(df, hot_rows=hot_rows).collect()}
    assert fused.keys() == two_steps.keys()
    assert all(fused[k] == pytest.approx(v) for k, v in two_steps.items())


@pytest.mark.parametrize("guard", [False, True])
def test_rarity_by_brute_force(lopsided, guard):
    rows, df = lopsided
    got = {(r.q_id, r.rollout_idx): r.rarity for r in G.rarity(df, guard=guard, hot_rows=5).collect()}
    assert len(got) == len(rows)
    for q, members in by_group(rows).items():
        values = [r for _, r in members]
        shares = [1 / values.count(r) for r in values]
        for (i, _), s in zip(members, shares):
            if guard and len(set(shares)) == 1:
                want = 0.0
            elif len(shares) == 1:
                want = None
            else:
                want = (s - statistics.mean(shares)) / (statistics.stdev(shares) + 1e-6)
            assert got[q, i] is None if want is None else got[q, i] == pytest.approx(want, abs=1e-6)


def test_hot_rows_spread_over_tasks(spark, lopsided):
    """The lane has to stay in the join key, else all hot rows would meet in one task."""
    _, df = lopsided
    # partitions this small are otherwise put together again after the join
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        joined = G.group_advantage(df, hot_rows=100)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [q_id" in plan and "_lane" in plan.split("SortMergeJoin [q_id")[1].split("]")[0]
        tasks = joined.where("q_id = 0").groupBy(F.spark_partition_id()).count().count()
        assert tasks > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lookup_join_is_an_inner_join(spark, lopsided):
    rows, df = lopsided
    asked = spark.createDataFrame([(q, f"question {q}") for q in range(50)], "q_id long, question string")
    want = sorted((q, i, f"question {q}") for q, i, _ in rows if q < 50)
    for hot_rows in (5, 10**6):
        got = J.attach_questions(df, asked, hot_rows=hot_rows)
        assert sorted((r.q_id, r.rollout_idx, r.question) for r in got.collect()) == want


def test_hot_groups_are_bounded(spark, monkeypatch, lopsided):
    """A key is hot only beyond one part in SHARES of all rows, so there cannot be more of them."""
    _, df = lopsided
    stats = skew.group_stats(df, ["q_id"])
    assert {r.q_id for r in skew.hot_groups(stats, ["q_id"], 100).collect()} == {0}
    lanes = {r.q_id: r._lanes for r in skew.hot_groups(stats, ["q_id"], 3).collect()}
    assert lanes[0] == 134 and all(n in (2, 3) for q, n in lanes.items() if q)
    monkeypatch.setattr(skew, "SHARES", 3)  # more than 400 of 1,200 rows
    assert skew.hot_groups(stats, ["q_id"], 1).count() == 0
    monkeypatch.setattr(skew, "SHARES", 4)
    assert {r.q_id for r in skew.hot_groups(stats, ["q_id"], 1).collect()} == {0}


def test_many_hot_keys_each_in_several_tasks(spark):
    """More hot keys than any fixed list would hold: 12,000 of 40 rows, ten to a lane."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("-1", "false", "16")):
        spark.conf.set(k, v)
    try:
        rows = spark.range(480_000).select((F.col("id") % 12_000).alias("q_id"), F.col("id").alias("rollout_idx"))
        asked = spark.range(12_000).select(F.col("id").alias("q_id"), F.concat(F.lit("question "), "id").alias("question"))
        done = J.attach_questions(rows, asked, hot_rows=10).withColumn("_task", F.spark_partition_id())
        tasks = done.groupBy("q_id").agg(F.count_distinct("_task").alias("n"), F.count(F.lit(1)).alias("rows"))
        low = tasks.agg(F.min("n").alias("n"), F.min("rows").alias("rows"), F.max("rows").alias("most"), F.count(F.lit(1)).alias("keys")).first()
        assert (low.rows, low.most, low.keys) == (40, 40, 12_000)
        # four lanes of a key meet in one of 16 partitions by chance only
        assert tasks.where("n < 2").count() < 12
        assert done.where("question <> concat('question ', q_id)").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_left_lookup_keeps_rows_without_a_match_or_key(spark):
    rows = spark.createDataFrame([(None, i) for i in range(30)] + [(1, 0), (2, 0)], "q_id long, rollout_idx long")
    asked = spark.createDataFrame([(1, "one"), (None, "none")], "q_id long, question string")
    got = skew.join_lookup(rows, asked, ["q_id"], how="left").collect()
    assert len(got) == 32 and {r.question for r in got if r.q_id == 1} == {"one"}
    assert all(r.question is None for r in got if r.q_id != 1)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_running_totals(lopsided, width, descending):
    rows, df = lopsided
    got = running_totals(
        df, ["q_id"], ["rollout_idx"], width_bucket("rollout_idx", width), {"s": F.col("reward"), "n": F.lit(1)}, descending
    )
    seen = {(r.q_id, r.rollout_idx): (r.s, r.n) for r in got.collect()}
    for q, members in by_group(rows).items():
        total, count = 0.0, 0
        for i, r in sorted(members, reverse=descending):
            total, count = total + r, count + 1
            assert seen[q, i] == (pytest.approx(total), count)


def test_global_rank_over_keys(spark):
    df = spark.range(5000).withColumn("k", F.md5(F.col("id").cast("string").cast("binary")))
    got = sorted((r.rank, r.k) for r in ranked(df, [], ["k"], key_bucket("k", 2)).collect())
    assert [n for n, _ in got] == list(range(1, 5001))
    assert [k for _, k in got] == sorted(k for _, k in got)


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_ranks_of_hot_groups(lopsided, hot_rows):
    rows, df = lopsided
    marked, bucket = bucket_hot_groups(df, ["q_id"], width_bucket("rollout_idx", 16), hot_rows)
    got = {(r.q_id, r.rollout_idx): r["rank"] for r in ranked(marked, ["q_id"], ["rollout_idx"], bucket).collect()}
    assert got == {(q, i): i + 1 for q, i, _ in rows}


def test_shuffled_batches_of_a_hot_draw(lopsided):
    rows, df = lopsided
    draws = df.withColumn("draw_id", (F.col("q_id") > 0).cast("int"))
    cold = {(r.q_id, r.rollout_idx): r.micro_batch for r in B.shuffle_batches(draws, 8, 1).collect()}
    hot = {(r.q_id, r.rollout_idx): r.micro_batch for r in B.shuffle_batches(draws, 8, 1, parts=10).collect()}
    assert cold == hot and len(hot) == len(rows)
    sizes = {}
    for (q, _), b in hot.items():
        sizes[q > 0, b] = sizes.get((q > 0, b), 0) + 1
    assert all(n == 8 for n in list(sizes.values())[:-2]) or sum(n != 8 for n in sizes.values()) <= 2


def test_insert_think(spark):
    rows = [("q", i, 2.25 if i in (1, 3) else 0.0, f"t{i}</think>a") for i in range(5)]
    rows += [("none", 0, 0.0, "x</think>y"), ("bare", 0, 2.25, "no thought")]
    df = spark.createDataFrame(rows, "q_id string, rollout_idx int, reward double, answer string")
    done = {(r.q_id, r.rollout_idx): r.answer for r in G.insert_think(df).collect()}
    changed = [k for k, a in done.items() if "<think></think>" in a]
    assert len(done) == len(rows) and len(changed) == 1 and changed[0] in {("q", 1), ("q", 3)}
    quirk = {(r.q_id, r.rollout_idx): r.answer for r in G.insert_think(df, quirk=True).collect()}
    (where,) = [k for k, a in quirk.items() if "<think></think>" in a]
    assert where in {("q", 0), ("q", 1)} and quirk[where].startswith(("t1", "t3"))
    assert quirk["bare", 0] == "no thought"


def test_advantages_sum_to_zero(lopsided):
    _, df = lopsided
    sums = G.group_advantage(df).groupBy("q_id").agg(F.sum("advantage").alias("s")).where("s IS NOT NULL").collect()
    assert all(math.isclose(r.s, 0, abs_tol=1e-6) for r in sums)


def test_worked_advantage(spark):
    df = spark.createDataFrame([(1, 0, 2.25), (1, 1, -2.0)], "q_id long, rollout_idx long, reward double")
    got = sorted(r.advantage for r in G.group_advantage(df).collect())
    assert got == [pytest.approx(-0.707083, abs=1e-6), pytest.approx(0.707083, abs=1e-6)]


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_blend_is_advantage_plus_rarity(lopsided, hot_rows):
    rows, df = lopsided
    apart = G.rarity(G.group_advantage(df)).collect()
    want = {(r.q_id, r.rollout_idx): None if r.advantage is None else r.advantage + 0.05 * r.rarity for r in apart}
    got = {(r.q_id, r.rollout_idx): r.advantage for r in G.blend_rarity(df, hot_rows=hot_rows).collect()}
    assert got.keys() == want.keys() and len(got) == len(rows)
    assert all(got[k] is None if want[k] is None else got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("descending", [False, True])
def test_sparse_orders(spark, descending):
    import random

    rng = random.Random(9)
    values = rng.sample(range(2**61), 3000)
    df = spark.createDataFrame([(v % 2, v) for v in values], "producer int, at long")
    done = ranked(df, ["producer"], ["at"], width_bucket("at", 2**40), "n", descending, coarse=2**10)
    got = {(r.producer, r.at): r.n for r in done.collect()}
    want = {}
    for p in (0, 1):
        mine = sorted((v for v in values if v % 2 == p), reverse=descending)
        want.update({(p, v): i + 1 for i, v in enumerate(mine)})
    assert got == want
