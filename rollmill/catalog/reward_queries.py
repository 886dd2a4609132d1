"""Reward expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.catalog.registry import query, r6
from rollmill.catalog.views import (
    CODE_TASKS, IDS, ROLLOUT_ID, ROLLOUTS, code_tasks, rollouts, table, token_ids, with_views,
)
from rollmill.functions import rewards as R
from rollmill.functions import text as T

_ID = ", ".join(["q_id", *ROLLOUT_ID])


@query(with_views(ROLLOUTS) + f"""SELECT {_ID}, reward AS sum_reward,
 CAST(CASE WHEN format_ok AND correct THEN 2 WHEN format_ok THEN 0.5 ELSE -2 END AS DOUBLE) AS tier_reward FROM rollouts""")
def sum_and_tier_reward(spark, sf):
    return rollouts(spark, sf).select(
        "q_id", *ROLLOUT_ID, R.sum_reward("correct", "format_ok").alias("sum_reward"),
        R.tier_reward("correct", "format_ok").alias("tier_reward"),
    )


_SCHEDULED = """SELECT q_id, line, partkey, suppkey, version, round(CASE WHEN version >= 16
  THEN 2 * acc + fmt + tool ELSE acc + 2 * fmt + 2 * tool END, 6) AS reward FROM (
 SELECT q_id, line, partkey, suppkey, CAST(partkey % 32 AS INT) AS version, CASE WHEN correct THEN 1 ELSE -1 END::DOUBLE AS acc,
  CASE WHEN format_ok THEN 1 ELSE -1 END::DOUBLE AS fmt, (line % 4) * 0.1::DOUBLE AS tool FROM rollouts)"""


@query(with_views(ROLLOUTS) + _SCHEDULED)
def scheduled_reward(spark, sf):
    sign = {c: F.when(F.col(c), 1.0).otherwise(-1.0) for c in ("correct", "format_ok")}
    version = (F.col("partkey") % 32).cast("int")
    tool = T.tool_score(F.concat("answer", F.repeat(F.lit(T.CODE_FENCE), F.col("line") % 4)))
    reward = R.scheduled_reward(sign["correct"], sign["format_ok"], tool, version)
    return rollouts(spark, sf).select("q_id", *ROLLOUT_ID, version.alias("version"), r6(reward).alias("reward"))


@query(with_views(CODE_TASKS) + """SELECT idx, CASE WHEN idx % 4 = 0 THEN -1 ELSE 1 END::DOUBLE AS fence_reward,
  CASE WHEN idx % 4 <> 0 AND idx % 5 = 0 THEN 1 ELSE -1 END::DOUBLE AS full_reward FROM code_tasks""")
def code_format_reward(spark, sf):
    ids = F.array(F.col("idx") % 7 + 100, (F.col("idx") % 5).cast("bigint"))
    return code_tasks(spark, sf).select(
        "idx", R.code_format_reward(T.python_block_flag("answer")).alias("fence_reward"),
        R.code_format_reward(T.python_block_flag("answer"), ids, 0).alias("full_reward"),
    )


@query(with_views(ROLLOUTS) + f"""SELECT {_ID}, CASE WHEN correct THEN 1 ELSE -1 END::DOUBLE AS correct_reward,
 CASE WHEN format_ok THEN 1.25 ELSE -1 END::DOUBLE AS format_reward,
 CASE WHEN format_ok AND line > 2 THEN 1 ELSE -1 END::DOUBLE AS format_reward_strict FROM rollouts""")
def export_rewards(spark, sf):
    strict = F.col("format_ok") & (F.col("line") > 2)
    return rollouts(spark, sf).select("q_id", *ROLLOUT_ID, *R.export_rewards("correct", "format_ok", strict))


@query(with_views(ROLLOUTS) + f"""SELECT {_ID}, CASE WHEN correct THEN 1 ELSE -1 END::DOUBLE AS accuracy,
 CASE WHEN format_ok THEN 1.25 ELSE -1 END::DOUBLE AS form, length(answer) AS size,
 round(2 * CASE WHEN correct THEN 1 ELSE -1 END + 0.5 * CASE WHEN format_ok THEN 1.25 ELSE -1 END - 0.01 * length(answer), 6)::DOUBLE AS reward
 FROM rollouts""")
def register_reward(spark, sf):
    rewards = (
        R.RewardSet()
        .register_reward("accuracy", lambda a, g: R.correct_reward(T.numeric_correct(a, g)), 2.0)
        .register_reward("form", lambda a, g: R.format_reward(T.think_format_strict(a)), 0.5)
        .register_reward("size", lambda a, g: F.length(a).cast("bigint"), -0.01)
    )
    scored = rewards.apply(rollouts(spark, sf).drop("reward"))
    return scored.select("q_id", *ROLLOUT_ID, "accuracy", "form", "size", r6("reward").alias("reward"))


@query(with_views(IDS) + "SELECT rollout_id, list_contains(answer_ids, 0) AS has_end FROM ids")
def end_token_found(spark, sf):
    return token_ids(spark, sf).select(
        "rollout_id", (R.code_format_reward(F.lit(1), "answer_ids", 0) == 1.0).alias("has_end")
    )


@query("""SELECT l_orderkey AS q_id, l_linenumber AS line, l_partkey AS partkey,
 CAST(l_linenumber AS INT) AS plen, round(l_quantity / 7, 6) AS rmean, CAST(NULL AS DOUBLE) AS rvar FROM lineitem""")
def batch_meta(spark, sf):
    from rollmill.sources.batches import batch_meta as decode

    packed = F.to_json(F.struct(F.col("l_linenumber").alias("plen"), (F.col("l_quantity") / 7).alias("rmean")))
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("q_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("partkey"),
        decode(packed).alias("meta"),
    )
    return rows.select("q_id", "line", "partkey", "meta.plen", r6("meta.rmean").alias("rmean"), "meta.rvar")
