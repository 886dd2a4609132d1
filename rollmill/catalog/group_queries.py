"""Group statistics, advantages, rarity and flat-group filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.catalog.registry import query, r6
from rollmill.catalog.views import ROLLOUT_ID, ROLLOUTS, questions, rollouts, with_views
from rollmill.operators import groups as G
from rollmill.plans import grpo

_ID = ", ".join(["q_id", *ROLLOUT_ID])
_SPREAD = tuple(ROLLOUT_ID)


def _round(x: str) -> str:
    return f"round({x}, 6) + 0e0"


_Z = "(reward - avg(reward) OVER g) / (stddev_samp(reward) OVER g + 1e-4)"
_WINDOW = " WINDOW g AS (PARTITION BY q_id)"


@query(with_views(ROLLOUTS) + f"""SELECT q_id, rollout_idx, reward, {_round('advantage')} AS advantage FROM (
 SELECT *, max(reward) OVER g - min(reward) OVER g AS span, {_Z} AS advantage FROM rollouts{_WINDOW}) WHERE span >= 1e-4""")
def grpo_advantages(spark, sf):
    done = grpo.grpo_advantages(
        rollouts(spark, sf, idx=True).select("q_id", "rollout_idx", "answer"),
        questions(spark, sf).select("q_id", "gold"),
    )
    return done.select("q_id", "rollout_idx", "reward", r6("advantage").alias("advantage"))


@query(with_views(ROLLOUTS) + f"""SELECT q_id, rollout_idx, {_round('advantage')} AS advantage, (row_number() OVER (PARTITION BY q_id ORDER BY rollout_idx) - 1) // 3 AS micro_batch
 FROM (SELECT *, max(reward) OVER g - min(reward) OVER g AS span, {_Z} AS advantage FROM rollouts{_WINDOW}) WHERE span >= 1e-4""")
def grpo_batches(spark, sf):
    done = grpo.grpo_batches(
        rollouts(spark, sf, idx=True).select("q_id", "rollout_idx", "answer"), questions(spark, sf).select("q_id", "gold"), 3
    )
    return done.select("q_id", "rollout_idx", r6("advantage").alias("advantage"), "micro_batch")


@query(with_views(ROLLOUTS) + f"SELECT {_ID}, {_round(_Z)} AS advantage FROM rollouts{_WINDOW}")
def group_advantage(spark, sf):
    done = G.group_advantage(rollouts(spark, sf), spread=_SPREAD)
    return done.select("q_id", *ROLLOUT_ID, r6("advantage").alias("advantage"))


@query(with_views(ROLLOUTS) + f"""SELECT {_ID}, {_round('(reward - avg(reward) OVER g) / nullif(stddev_samp(reward) OVER g, 0)')}
 AS advantage FROM rollouts{_WINDOW}""")
def group_advantage_no_eps(spark, sf):
    done = G.group_advantage(rollouts(spark, sf), eps=0.0, spread=_SPREAD)
    return done.select("q_id", *ROLLOUT_ID, r6("advantage").alias("advantage"))


@query(with_views(ROLLOUTS) + f"""SELECT {_ID}, rule FROM (
  SELECT *, max(reward) OVER g - min(reward) OVER g AS span, max(reward) OVER (PARTITION BY q_id // 4)
   - min(reward) OVER (PARTITION BY q_id // 4) AS draw_span FROM rollouts{_WINDOW})
 JOIN (VALUES ('question', 1e-4), ('question', 0.01), ('pool', 0.25), ('draw', 1e-4)) r(kind, tol) ON
  (kind = 'question' AND span >= tol) OR (kind = 'pool' AND span > tol) OR (kind = 'draw' AND draw_span >= tol)
 , LATERAL (SELECT concat(kind, ' ', tol::DOUBLE) AS rule)""".replace("concat(kind, ' ', tol::DOUBLE)", "concat(kind, ' ', printf('%.4f', tol))"))
def drop_flat_groups(spark, sf):
    rows = rollouts(spark, sf).select("q_id", *ROLLOUT_ID, "reward", F.floor(F.col("q_id") / 4).alias("draw_id"))
    kept = [
        G.drop_flat_groups(rows, 1e-4, spread=_SPREAD).withColumn("rule", F.lit("question 0.0001")),
        G.drop_flat_groups(rows, 0.01, spread=_SPREAD).withColumn("rule", F.lit("question 0.0100")),
        G.drop_flat_groups(rows, 0.25, spread=_SPREAD, inclusive=True).withColumn("rule", F.lit("pool 0.2500")),
        G.drop_flat_groups(rows, 1e-4, ("draw_id",), spread=_SPREAD).withColumn("rule", F.lit("draw 0.0001")),
    ]
    merged = kept[0]
    for more in kept[1:]:
        merged = merged.unionByName(more)
    return merged.select("q_id", *ROLLOUT_ID, "rule")


@query(with_views(ROLLOUTS) + """SELECT bin, sum(n)::BIGINT AS n FROM (
 SELECT printf('%.2f', reward) AS bin, count(*) AS n FROM rollouts GROUP BY 1
 UNION ALL SELECT unnest(['-2.00', '0.00', '0.25', '2.25', '9.00']), 0) GROUP BY bin""")
def reward_histogram(spark, sf):
    return G.reward_histogram(rollouts(spark, sf), [*G.REWARD_BINS, "9.00"])


@query(with_views(ROLLOUTS) + f"""SELECT q_id, {_round('avg(reward)')} AS rmean, {_round('var_samp(reward) + 1e-9')} AS rvar
 FROM rollouts GROUP BY q_id""")
def group_moments(spark, sf):
    # the shift keeps binary fractions such as 1.1328125 off a rounding tie
    moments = G.group_moments(rollouts(spark, sf))
    return moments.select("q_id", r6("rmean").alias("rmean"), r6(F.col("rvar") + 1e-9).alias("rvar"))


@query(with_views(ROLLOUTS) + "SELECT q_id, reward, count(*) AS n FROM rollouts GROUP BY q_id, reward")
def distinct_rewards(spark, sf):
    return G.distinct_rewards(rollouts(spark, sf))


_RARE = "rare AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY q_id, reward) AS share FROM rollouts)"
_RARITY = "(share - avg(share) OVER g) / (stddev_samp(share) OVER g + 1e-6)"
_SAME = "max(share) OVER g = min(share) OVER g"
_GUARDED = f"CASE WHEN {_SAME} THEN 0.0 ELSE {_RARITY} END"
# a flat group has a rarity of exactly zero; SQL leaves rounding noise over 1e-6 there
_PLAIN = f"CASE WHEN {_SAME} AND count(*) OVER g > 1 THEN 0.0 ELSE {_RARITY} END"


@query(with_views(ROLLOUTS, _RARE) + f"""SELECT {_ID}, {_round(_PLAIN)} AS rarity, {_round(_GUARDED)} AS guarded
 FROM rare{_WINDOW}""")
def rarity(spark, sf):
    plain = G.rarity(rollouts(spark, sf), spread=_SPREAD)
    both = G.rarity(plain, guard=True, spread=_SPREAD, name="guarded")
    return both.select("q_id", *ROLLOUT_ID, r6("rarity").alias("rarity"), r6("guarded").alias("guarded"))


@query(with_views(ROLLOUTS, _RARE) + f"""SELECT {_ID}, {_round(f'{_Z} + 0.05 * {_PLAIN}')} AS advantage FROM rare{_WINDOW}""")
def blend_rarity(spark, sf):
    done = G.blend_rarity(rollouts(spark, sf), spread=_SPREAD)
    return done.select("q_id", *ROLLOUT_ID, r6("advantage").alias("advantage"))


@query(with_views(ROLLOUTS, _RARE) + f"""SELECT {_ID}, {_round('rarity')} AS rarity FROM (
 SELECT *, max(abs(rarity)) OVER (PARTITION BY q_id) AS top FROM (SELECT *, {_GUARDED} AS rarity FROM rare{_WINDOW}))
 WHERE top > 0""")
def drop_flat_rarity(spark, sf):
    scored = G.rarity(rollouts(spark, sf), guard=True, spread=_SPREAD)
    return G.drop_flat_rarity(scored, spread=_SPREAD).select("q_id", *ROLLOUT_ID, r6("rarity").alias("rarity"))


@query(with_views(ROLLOUTS, _RARE) + f"""SELECT {_ID}, kind, {_round('value')} AS value FROM (
 SELECT {_ID}, 'advantage' AS kind, {_Z} AS value FROM rollouts{_WINDOW}
 UNION ALL SELECT {_ID}, 'rarity', {_PLAIN} FROM rare{_WINDOW})""")
def stack_advantages(spark, sf):
    scored = G.rarity(G.group_advantage(rollouts(spark, sf), spread=_SPREAD), spread=_SPREAD)
    return G.stack_advantages(scored).select("q_id", *ROLLOUT_ID, "kind", r6("value").alias("value"))


def _thought(quirk: bool) -> str:
    target = "place - 1" if quirk else "rollout_idx"
    return with_views(ROLLOUTS) + f""", full_ones AS (
 SELECT q_id, rollout_idx, answer, row_number() OVER (PARTITION BY q_id ORDER BY rollout_idx) AS place,
  row_number() OVER (PARTITION BY q_id ORDER BY md5(concat_ws(':', '7', q_id, rollout_idx))) AS pick
 FROM rollouts WHERE reward = 2.25),
 picked AS (SELECT q_id, {target} AS rollout_idx, concat(substr(answer, 1, strpos(answer, '</think>') + 7),
  '<think></think>', substr(answer, strpos(answer, '</think>') + 8)) AS grown FROM full_ones WHERE pick = 1)
SELECT r.q_id, r.rollout_idx, coalesce(grown, answer) AS answer FROM rollouts r LEFT JOIN picked p
 ON r.q_id = p.q_id AND r.rollout_idx = p.rollout_idx"""


@query(_thought(False))
def insert_think(spark, sf):
    return G.insert_think(rollouts(spark, sf, idx=True), seed=7).select("q_id", "rollout_idx", "answer")


@query(_thought(True))
def insert_think_quirk(spark, sf):
    return G.insert_think(rollouts(spark, sf, idx=True), seed=7, quirk=True).select("q_id", "rollout_idx", "answer")
