"""Pools, draws, batches, orders and curricula."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.catalog.registry import query, r6
from rollmill.catalog.views import (
    GRADED, IDS, ROLLOUTS, TOKENS, UPLOADS, graded, rollouts, table, token_ids, tokens, uploads, with_views,
)
from rollmill.operators import batching as B
from rollmill.operators import filters
from rollmill.plans import grpo
from rollmill.plans import regroup as regroup_plan


def _round(x: str) -> str:
    return f"round({x}, 6) + 0e0"


@query(with_views(UPLOADS) + "SELECT q, answer, reward, arrival FROM uploads QUALIFY row_number() OVER (PARTITION BY q ORDER BY arrival DESC) <= 60")
def keep_last(spark, sf):
    return B.keep_last(uploads(spark, sf), 60)


def regroup_sql(source: str, seed: str) -> str:
    return f"""drawn AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY q ORDER BY md5(concat_ws(':', '{seed}', q, arrival))) <= 8)
SELECT q, answer, arrival, {_round('(reward - mean) / nullif(std, 0)')} AS advantage FROM (
 SELECT *, count(*) OVER g AS n, max(reward) OVER g AS hi, min(reward) OVER g AS lo, avg(reward) OVER g AS mean,
  stddev_samp(reward) OVER g AS std FROM drawn WINDOW g AS (PARTITION BY q)) WHERE n >= 8 AND NOT hi <= lo + 0.1"""


POOL = "pool AS (SELECT * FROM uploads QUALIFY row_number() OVER (PARTITION BY q ORDER BY arrival DESC) <= 100)"


@query(with_views(UPLOADS, POOL, regroup_sql("pool", "0")))
def regroup(spark, sf):
    done = regroup_plan.regrouped(uploads(spark, sf))
    return done.select("q", "answer", "arrival", r6("advantage").alias("advantage"))


@query(with_views(ROLLOUTS) + "SELECT q_id, rollout_idx, (row_number() OVER (PARTITION BY q_id ORDER BY rollout_idx) - 1) // 2 AS micro_batch FROM rollouts")
def micro_batches(spark, sf):
    return B.micro_batches(rollouts(spark, sf, idx=True), 2).select("q_id", "rollout_idx", "micro_batch")


@query(with_views(ROLLOUTS) + """SELECT draw_id, q_id, rollout_idx, (row_number() OVER (PARTITION BY draw_id
 ORDER BY md5(concat_ws(':', '3', q_id, rollout_idx))) - 1) // 4 AS micro_batch FROM (SELECT *, q_id // 8 AS draw_id FROM rollouts)""")
def shuffle_batches(spark, sf):
    rows = rollouts(spark, sf, idx=True).select(F.floor(F.col("q_id") / 8).alias("draw_id"), "q_id", "rollout_idx")
    return B.shuffle_batches(rows, 4, seed=3)


@query("""SELECT o_custkey AS producer, o_orderkey AS batch_id, (row_number() OVER (PARTITION BY o_custkey
 ORDER BY o_orderkey) - 1) // 4 AS macro_id FROM orders""")
def macro_batches(spark, sf):
    index = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("producer"), F.col("o_orderkey").alias("batch_id"), F.col("o_orderkey").alias("arrival")
    )
    return B.macro_batches(index, 4).select("producer", "batch_id", "macro_id")


@query(with_views(TOKENS) + "SELECT rollout_id, pos, macro_id FROM tokens WHERE macro_id IN (SELECT DISTINCT macro_id FROM tokens ORDER BY 1 DESC LIMIT 3)")
def keep_latest_macro(spark, sf):
    return B.keep_latest_macro(tokens(spark, sf)).select("rollout_id", "pos", "macro_id")


@query(with_views(ROLLOUTS) + """, rounds AS (SELECT q_id AS round, max(reward) - min(reward) >= 0.01 AS usable FROM rollouts GROUP BY q_id)
SELECT min(round) AS first_round, max(round) AS last_round, count(*) AS idle_rounds FROM (
 SELECT *, row_number() OVER (ORDER BY round) - row_number() OVER (PARTITION BY usable ORDER BY round) AS island FROM rounds)
 WHERE NOT usable GROUP BY island HAVING count(*) >= 2""")
def saturation(spark, sf):
    rounds = rollouts(spark, sf).groupBy(F.col("q_id").alias("round")).agg(
        (F.max("reward") - F.min("reward") >= 0.01).alias("usable")
    )
    return B.saturation(rounds, run=2)


@query(with_views(GRADED) + "SELECT doc_id, q_id FROM graded ORDER BY doc_id LIMIT 100")
def head_samples(spark, sf):
    return B.head_samples(graded(spark, sf).select("doc_id", "q_id"), 100, "doc_id")


@query(with_views(GRADED) + "SELECT doc_id, q_id FROM graded")
def head_samples_all(spark, sf):
    return B.head_samples(graded(spark, sf).select("doc_id", "q_id"), 0, "doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(concat_ws(':', '11', o_orderkey)) LIMIT 500")
def sample_k(spark, sf):
    return B.sample_k(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 500, 11, ["o_orderkey"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws(':', '11', o_orderkey))) AS draw_no FROM orders")
def draw_order(spark, sf):
    return B.draw_order(table(spark, sf, "orders").select("o_orderkey"), 11, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders")
def shuffle(spark, sf):
    return B.shuffle(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 11, ["o_orderkey"])


@query(with_views(UPLOADS) + """SELECT arrival, q, row_number() OVER (ORDER BY arrival) AS fifo, row_number() OVER (ORDER BY arrival DESC) AS lifo FROM uploads""")
def delivery_order(spark, sf):
    rows = uploads(spark, sf).select("arrival", "q")
    oldest = B.delivery_order(rows, "fifo", name="fifo")
    return B.delivery_order(oldest, "lifo", name="lifo")


@query("""SELECT p_partkey AS idx, epoch::INT AS epoch, (p_partkey - CASE WHEN epoch = 0 THEN 0 ELSE 1000 END) // 32 AS batch
 FROM part, range(3) e(epoch) WHERE epoch = 0 OR p_partkey >= 1000""")
def curriculum(spark, sf):
    return B.curriculum(table(spark, sf, "part").select(F.col("p_partkey").alias("idx")), 32, epochs=3)


@query("SELECT event_id AS step, event_id % 200 = 0 OR event_id + 10 IN (40, 80, 100, 250) AS due FROM events")
def milestone(spark, sf):
    steps = table(spark, sf, "events").select(F.col("event_id").alias("step"))
    return steps.withColumn("due", B.milestone("step", 200, (40, 80, 100, 250), 10))


@query(with_views(IDS) + "SELECT rollout_id FROM ids WHERE len(prompt_ids) <= 8")
def max_prompt_tokens(spark, sf):
    return filters.max_prompt_tokens(token_ids(spark, sf), 8).select("rollout_id")


@query(with_views(IDS) + """SELECT rollout_id, batch_id FROM (SELECT *, max(len(prompt_ids) + len(answer_ids)) OVER (PARTITION BY batch_id) AS longest
 FROM ids) WHERE longest <= 45""")
def max_total_tokens(spark, sf):
    rows = token_ids(spark, sf).withColumn("input_ids", F.concat("prompt_ids", "answer_ids"))
    return filters.max_total_tokens(rows, 45, "input_ids").select("rollout_id", "batch_id")


@query(with_views(TOKENS) + "SELECT rollout_id, pos FROM tokens WHERE NOT (NOT valid AND logp < -0.1)")
def drop_nan(spark, sf):
    broken = ~F.col("valid") & (F.col("logp") < -0.1)
    rows = tokens(spark, sf).withColumn("loss", F.when(broken, F.lit(float("nan"))).otherwise(F.col("logp")))
    return filters.drop_nan(rows, "loss").select("rollout_id", "pos")


@query(with_views(IDS) + "SELECT rollout_id FROM ids WHERE label > 6")
def drop_missing_logps(spark, sf):
    empty = F.array().cast("array<int>")
    kept = F.when(F.col("label") <= 3, F.lit(None)).when(F.col("label") <= 6, empty).otherwise(F.col("answer_ids"))
    return filters.drop_missing_logps(token_ids(spark, sf).withColumn("gen_logps", kept)).select("rollout_id")


@query(with_views(IDS) + """SELECT rollout_id AS batch_id, CASE label % 4 WHEN 0 THEN 'ok' WHEN 3 THEN 'ok' ELSE 'rejected' END AS verdict FROM ids""")
def validate_batches(spark, sf):
    kind = F.col("label") % 4
    rows = token_ids(spark, sf).select(
        F.col("rollout_id").alias("batch_id"),
        F.when(kind != 1, F.size("prompt_ids")).alias("plen"),
        F.array("answer_ids", "answer_ids").alias("inputs"),
        F.when(kind == 2, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(-1.0))).alias("rewards"),
        F.when(kind == 3, F.array(F.array(F.lit(0.0)), F.array(F.lit(0.0)))).alias("gen_logps"),
    )
    good, bad = filters.validate_batches(rows)
    return good.select("batch_id", F.lit("ok").alias("verdict")).unionByName(
        bad.select("batch_id", F.lit("rejected").alias("verdict"))
    )


@query(with_views(IDS) + """, placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rollout_id) - 1 AS place FROM ids),
 sized AS (SELECT *, place // 4 AS micro_batch, max(len(answer_ids)) OVER (PARTITION BY label, place // 4) AS longest FROM placed)
SELECT label AS q_id, micro_batch, len(prompt_ids[1:8])::INT AS plen, rollout_id, array_to_string(list_concat(prompt_ids[1:8], answer_ids,
  list_transform(range(longest - len(answer_ids)), lambda x: -1)), ',') AS input_ids FROM sized""".replace("prompt_ids[1:8]", "prompt_ids"))
def batch_messages(spark, sf):
    rows = token_ids(spark, sf).select(
        F.col("label").alias("q_id"), F.col("rollout_id").alias("rollout_idx"), "prompt_ids", "answer_ids",
        F.col("rollout_id").cast("double").alias("advantage"),
    )
    packed = grpo.batch_messages(B.micro_batches(rows, 4, width=1024), -1)
    each = packed.select("q_id", "micro_batch", "plen", F.inline(F.arrays_zip("inputs", "rewards")))
    return each.select(
        "q_id", "micro_batch", "plen", F.col("rewards").cast("bigint").alias("rollout_id"),
        F.array_join(F.transform("inputs", lambda x: x.cast("string")), ",").alias("input_ids"),
    )



@query(with_views(UPLOADS, POOL) + f""", done AS (WITH {regroup_sql('pool', '0')}),
 placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY arrival) - 1 AS place, max(arrival % 5 + 1) OVER (PARTITION BY q) AS longest FROM done)
SELECT q, (place // 4)::INT AS micro_batch, 2::INT AS plen, (place % 4)::INT AS place, advantage AS reward,
 array_to_string(list_concat([q::INT % 7, q::INT % 11], range(arrival % 5 + 1), list_transform(range(longest - arrival % 5 - 1), lambda x: -1)), ',') AS input_ids FROM placed""")
def regrouped_batches(spark, sf):
    user, last = F.col("q").cast("int"), (F.col("arrival") % 5).cast("int")
    rows = uploads(spark, sf).withColumns({"prompt_ids": F.array(user % 7, user % 11), "answer_ids": F.sequence(F.lit(0), last)})
    done = regroup_plan.regrouped_batches(rows, -1)
    each = done.select("q", "micro_batch", "plen", F.posexplode(F.arrays_zip("inputs", "rewards")).alias("place", "r"))
    ids = F.array_join(F.transform(F.col("r.inputs"), lambda x: x.cast("string")), ",")
    return each.select("q", "micro_batch", "plen", "place", r6("r.rewards").alias("reward"), ids.alias("input_ids"))
