import json

import pytest
from pyspark.sql import functions as F

from rollmill.operators.batching import keep_last, regroup
from rollmill.plans import reinforce
from rollmill.schemas import UPLOAD
from rollmill.session import run_dir
from rollmill.streaming import macro, metrics, pool
from rollmill.streaming import uploads as U

ROWS = [(str(i % 3 if i % 2 else 0), f"a{i}", float((i * 5) % 4), i, None) for i in range(120)]


def drop(spark, path, rows):
    spark.createDataFrame(rows, UPLOAD).coalesce(1).write.mode("append").parquet(f"{path}/in")


@pytest.fixture()
def folder(spark):
    path = run_dir(spark, "stream-test")
    for k in range(4):
        drop(spark, path, ROWS[k * 30:(k + 1) * 30])
    return path


def test_pool_over_several_triggers(spark, folder):
    stream = U.rollout_stream(spark, f"{folder}/in", max_files=1)
    pool.pool_stream(stream, f"{folder}/ckpt", 10).awaitTermination()
    received = {q: sum(r[0] == q for r in ROWS) for q in {r[0] for r in ROWS}}
    assert {r.q: r.received for r in pool.received_answers(spark, f"{folder}/ckpt").collect()} == received
    want = keep_last(spark.createDataFrame(ROWS, UPLOAD), 10).select("q", "answer", "reward", "arrival")
    got = pool.pooled_answers(spark, f"{folder}/ckpt", 10).select("q", "answer", "reward", "arrival")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # an earlier trigger's pools are still there, and a list holds twice its answers at most
    early = pool.pooled_answers(spark, f"{folder}/ckpt", 10, trigger=1).collect()
    first = keep_last(spark.createDataFrame(ROWS[:60], UPLOAD), 10).select("q", "answer", "reward", "arrival")
    assert sorted(map(tuple, early)) == sorted(map(tuple, first.collect()))
    held = pool._state(spark, f"{folder}/ckpt", "answers", None).groupBy("key").count().collect()
    assert max(r["count"] for r in held) <= 20


def test_a_trigger_adds_one_element_to_a_pool(spark, folder):
    """Each element is a message to Python and back, so their number must not be that of the answers."""
    pool.pool_stream(U.rollout_stream(spark, f"{folder}/in", max_files=1), f"{folder}/ckpt", 100).awaitTermination()
    held = pool._state(spark, f"{folder}/ckpt", "answers", None).groupBy("key").count().collect()
    assert {r["count"] for r in held} == {4}
    assert sum(r.received for r in pool.received_answers(spark, f"{folder}/ckpt").collect()) == len(ROWS)
    got = pool.pooled_answers(spark, f"{folder}/ckpt").select("q", "answer", "reward", "arrival")
    assert sorted(map(tuple, got.collect())) == sorted(r[:4] for r in ROWS)


def test_a_trigger_of_one_file_is_shared_by_tasks(spark):
    from rollmill.catalog import stream_queries

    rows = spark.range(3_000_000).select(F.xxhash64("id").cast("string").alias("q"), F.col("id").alias("arrival"))
    stream = stream_queries._in_files(spark, rows, "row-groups", F.when(F.col("arrival") < 2_900_000, 0).otherwise(F.col("arrival") % 2 + 1))
    path = f"{run_dir(spark, 'row-groups')}"
    seen = {}

    def sizes(part, batch):
        seen[batch] = [r["count"] for r in part.groupBy(F.spark_partition_id()).count().collect()]

    stream.writeStream.foreachBatch(sizes).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    assert [sum(seen[k]) for k in range(3)] == [2_900_000, 50_000, 50_000]
    assert len(seen[0]) > 1 and max(seen[0]) < 2_000_000


def test_unchanged_pools_are_drawn_again(spark):
    path = run_dir(spark, "unchanged")
    drop(spark, path, [("still", f"s{i}", float(i), i, None) for i in range(9)])
    for k in range(2):
        drop(spark, path, [("busy", f"b{k}{i}", float(i), 10 * k + i, None) for i in range(9)])
    stream = U.rollout_stream(spark, f"{path}/in", max_files=1)
    pool.regroup_stream(stream, f"{path}/out", f"{path}/ckpt", min_total=1).awaitTermination()
    drawn = spark.read.parquet(f"{path}/out/groups").groupBy("batch", "q").agg(F.sort_array(F.collect_list("answer")).alias("a")).collect()
    still = {r.batch: r.a for r in drawn if r.q == "still"}
    assert sorted(still) == [0, 1, 2] and all(len(a) == 8 for a in still.values())
    assert len({tuple(a) for a in still.values()}) > 1  # a draw of its own each time


def test_the_setting_of_the_session_comes_back(spark, folder):
    before = spark.conf.get(pool.PROVIDER, None)
    pool.pool_stream(U.rollout_stream(spark, f"{folder}/in"), f"{folder}/ckpt").awaitTermination()
    assert spark.conf.get(pool.PROVIDER, None) == before


def test_pool_survives_a_restart(spark):
    path = run_dir(spark, "restart")
    for k in range(3):
        drop(spark, path, ROWS[k * 40:(k + 1) * 40])
        stream = U.rollout_stream(spark, f"{path}/in")
        pool.pool_stream(stream, f"{path}/ckpt", 10).awaitTermination()
    assert sum(r.received for r in pool.received_answers(spark, f"{path}/ckpt").collect()) == len(ROWS)


def test_regroup_waits_for_the_gate(spark):
    path = run_dir(spark, "gate")
    seen = []
    for k in range(4):
        drop(spark, path, ROWS[k * 25:(k + 1) * 25])
        stream = U.rollout_stream(spark, f"{path}/in")
        pool.regroup_stream(stream, f"{path}/out", f"{path}/ckpt").awaitTermination()
        groups = U.read_ready(spark, f"{path}/out/groups", UPLOAD)
        seen.append(groups.count() if k >= 2 else 0)
        if k == 1:
            assert groups.isEmpty()
    assert seen[2] > 0
    first = spark.read.parquet(f"{path}/out/groups").where("batch = 2")
    # the opening trigger draws from every question received so far
    want = regroup(keep_last(spark.createDataFrame(ROWS[:75], UPLOAD)), seed="0:2")
    key = lambda r: (r.q, r.arrival, round(r.advantage, 9))
    assert sorted(map(key, first.collect())) == sorted(map(key, want.collect()))


def test_batch_and_stream_agree(spark, folder):
    stream = U.rollout_stream(spark, f"{folder}/in")
    pool.regroup_stream(stream, f"{folder}/out", f"{folder}/ckpt").awaitTermination()
    got = spark.read.parquet(f"{folder}/out/groups")
    want = regroup(keep_last(spark.createDataFrame(ROWS, UPLOAD)), seed="0:0")
    key = lambda r: (r.q, r.arrival, round(r.advantage, 9))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    sizes = got.groupBy("q").count().collect()
    assert sizes and all(r["count"] == 8 for r in sizes)


def wide(spark, batches):
    rows = [
        (p, b, b, 4, 10 * b + i, float(i % 3), [-0.1 * (i + 1), -0.2, -0.3], [-0.2, -0.1 * i, -0.5], [True, True, i % 2 == 0])
        for p, b in batches for i in range(4)
    ]
    return spark.createDataFrame(rows, "producer long, batch_id long, arrival long, batch_rows int, rollout_id long, seq_reward double, "
                                       "gen_logps array<double>, ref_logps array<double>, valid array<boolean>")


def test_macro_batches_over_triggers(spark):
    path = run_dir(spark, "macro-test")
    batches = [(b % 2, b) for b in range(14)]
    for k in range(3):
        wide(spark, batches[k * 5:(k + 1) * 5]).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = U.rollout_stream(spark, f"{path}/in", wide(spark, batches[:1]).schema)
        macro.macro_stream(stream, f"{path}/out", f"{path}/ckpt", 3).awaitTermination()
    got = spark.read.parquet(f"{path}/out/macros")
    counts = {(r.producer, r.macro_id): r.n for r in got.groupBy("producer", "macro_id").agg(F.count_distinct("batch_id").alias("n")).collect()}
    assert counts == {(0, 0): 3, (0, 6): 3, (1, 1): 3, (1, 7): 3}
    whole = reinforce.macro_advantages(wide(spark, [b for b in batches if b[1] < 12]), 3)
    want = {r.rollout_id: r.advantages for r in whole.collect()}
    for r in got.collect():
        assert r.advantages == pytest.approx(want[r.rollout_id])
    assert len(want) == got.count() == 48


def test_split_batches_and_equal_arrivals(spark):
    """Batch 3 comes in two files, one of its answers twice; all arrivals are equal."""
    path = run_dir(spark, "split-test")
    rows = wide(spark, [(0, b) for b in range(9)]).withColumn("arrival", F.lit(5).cast("long"))
    first = rows.where("batch_id < 3 OR batch_id = 3 AND rollout_id < 32")
    second = rows.where("batch_id = 3 AND rollout_id >= 31 OR batch_id IN (4, 5)")
    for part in (first, second, rows.where("batch_id > 5")):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = U.rollout_stream(spark, f"{path}/in", rows.schema)
        macro.macro_stream(stream, f"{path}/out", f"{path}/ckpt", 3).awaitTermination()
    got = spark.read.parquet(f"{path}/out/macros").groupBy("macro_id").agg(
        F.sort_array(F.collect_set("batch_id")).alias("b"), F.count(F.lit(1)).alias("n")
    ).collect()
    assert {r.macro_id: (r.b, r.n) for r in got} == {0: ([0, 1, 2], 12), 3: ([3, 4, 5], 12), 6: ([6, 7, 8], 12)}
    assert spark.read.parquet(f"{path}/out/waiting").where("batch = 2").count() == 0


def test_metrics_add_up(spark):
    path = run_dir(spark, "metrics-test")
    steps = spark.createDataFrame([(s, 8, 100 + s, s % 9, 8) for s in range(20)], "step long, n_sequences int, padded_length int, n_correct int, n_format int")
    for k in range(2):
        steps.where(F.col("step") % 2 == k).write.mode("append").parquet(f"{path}/in")
        stream = U.rollout_stream(spark, f"{path}/in", steps.schema)
        metrics.write_metrics(metrics.running_training_stream(stream), f"{path}/out", f"{path}/ckpt").awaitTermination()
    assert spark.read.parquet(f"{path}/out").count() == 2
    row = metrics.read_metrics(spark, f"{path}/out").first()
    assert row.steps == 20 and row.format_correct_ratio == 1.0
    assert row.avg_output_token_length == pytest.approx(sum(100 + s for s in range(20)) / 20)


def test_generation_log_tolerates_bad_lines(spark):
    from rollmill.sources import logs

    path = run_dir(spark, "log-test")
    assert logs.read_generation_log(spark, path).count() == 0
    spark.createDataFrame([("{broken",), (json.dumps({"answer": "a", "acc_score": 1.0}),)], "value string").write.text(path)
    assert [r.answer for r in logs.read_generation_log(spark, path).collect()] == ["a"]


def test_a_table_in_several_files_is_one_trigger(spark, tmp_path):
    from rollmill.catalog.stream_queries import _stream

    rows = spark.range(30).repartition(3)
    rows.write.parquet(f"{tmp_path}/folder.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/other")
    next((tmp_path / "other").glob("*.parquet")).rename(tmp_path / "single.parquet")
    for name in ("folder", "single"):
        taken = []
        (
            _stream(spark, str(tmp_path), name).writeStream.foreachBatch(lambda new, k: taken.append(new.count()))
            .option("checkpointLocation", f"{tmp_path}/checkpoint-{name}").trigger(availableNow=True).start().awaitTermination()
        )
        assert taken == [30]


def test_the_generation_log_is_compressed(spark, tmp_path):
    from rollmill.sources import logs

    rows = spark.range(2000).select(
        F.lit("q").alias("question"), F.lit("g").alias("gold"), F.lit("word " * 50).alias("answer"), F.lit(1.0).alias("acc_score"), F.lit(1.0).alias("format_score")
    )
    for _ in range(2):
        logs.append_generation_log(rows.coalesce(1), f"{tmp_path}/log")
    assert logs.read_generation_log(spark, f"{tmp_path}/log").where(F.col("answer") == "word " * 50).count() == 4000
    assert sum(f.stat().st_size for f in (tmp_path / "log").glob("part-*")) < 100_000
