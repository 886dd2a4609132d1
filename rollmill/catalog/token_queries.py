"""Token-level masks, returns, standardisation, losses and array operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.catalog.registry import query, r6
from rollmill.catalog.views import IDS, TOKENS, sequences, table, token_ids, tokens, with_views
from rollmill.functions import arrays as A
from rollmill.operators import groups as G
from rollmill.operators import joins as J
from rollmill.operators import sequences as S
from rollmill.operators import tokens as K
from rollmill.plans import reinforce

_SPREAD = ("rollout_id", "pos")


def _round(x: str, name: str) -> str:
    return f"round({x}, 6) + 0e0 AS {name}"


def _ids(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


@query(with_views(TOKENS) + f"""SELECT rollout_id, pos, {_round('exp(ref_logp - logp) - (ref_logp - logp) - 1', 'k3')},
 {_round('gen_logp - ref_logp', 'k1')} FROM tokens""")
def kl_terms(spark, sf):
    return tokens(spark, sf).select(
        "rollout_id", "pos", r6(A.kl_k3("logp", "ref_logp")).alias("k3"), r6(A.kl_k1("gen_logp", "ref_logp")).alias("k1")
    )


@query(with_views(TOKENS) + f"""SELECT rollout_id, pos, {_round('least(exp(logp - gen_logp) * seq_reward, least(greatest(exp(logp - gen_logp), 0.8e0), 1.2e0) * seq_reward)', 'surrogate')},
 seq_reward AS on_policy FROM tokens""")
def clipped_surrogate(spark, sf):
    return tokens(spark, sf).select(
        "rollout_id", "pos", r6(A.clipped_surrogate("logp", "gen_logp", "seq_reward")).alias("surrogate"),
        A.clipped_surrogate("logp", None, "seq_reward").alias("on_policy"),
    )


@query(with_views(TOKENS) + "SELECT rollout_id, pos, logp, gen_logp, ref_logp FROM tokens")
def align_logps(spark, sf):
    rows = tokens(spark, sf)
    parts = [rows.select("rollout_id", "pos", c) for c in ("logp", "gen_logp", "ref_logp")]
    return K.align_logps(*parts)


@query(with_views(TOKENS) + f"""SELECT rollout_id, {_round('sum(ref_logp)', 'ref_total')}, any_value(seq_reward) AS seq_reward FROM tokens GROUP BY rollout_id""")
def enrich_with_ref(spark, sf):
    rows = sequences(spark, sf)
    done = J.enrich_with_ref(rows.select("rollout_id", "seq_reward"), rows.select("rollout_id", "ref_logps"))
    total = F.aggregate("ref_logps", F.lit(0.0), lambda a, x: a + x)
    return done.select("rollout_id", r6(total).alias("ref_total"), "seq_reward")


@query(with_views(TOKENS) + """SELECT rollout_id, pos, pos = coalesce(max(pos) FILTER (valid AND label > 0) OVER (PARTITION BY rollout_id),
 max(pos) OVER (PARTITION BY rollout_id)) AS is_eos FROM tokens""")
def eos_mask(spark, sf):
    rows = tokens(spark, sf).withColumn("valid", F.col("valid") & (F.col("label") > 0))
    return K.eos_mask(rows).select("rollout_id", "pos", "is_eos")


_EOS = "pos = max(pos) FILTER (valid) OVER (PARTITION BY rollout_id)"
_REWARDED = f"""rewarded AS (SELECT *, CASE WHEN valid THEN CASE WHEN {_EOS} THEN seq_reward ELSE 0 END
 - 0.01::DOUBLE * (gen_logp - ref_logp) ELSE 0 END AS r FROM tokens)"""
_FIRST = """first AS (SELECT *, CASE WHEN valid THEN (r - avg(r) FILTER (valid) OVER m) / (stddev_pop(r) FILTER (valid) OVER m + 1e-5)
 ELSE 0 END AS z FROM rewarded WINDOW m AS (PARTITION BY macro_id))"""
_RETURNS = """returns AS (SELECT *, sum(z) OVER (PARTITION BY rollout_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g FROM first)"""
_ADV = """advantages AS (SELECT *, (g - avg(g) FILTER (valid) OVER m) / (stddev_pop(g) FILTER (valid) OVER m + 1e-5) AS adv
 FROM returns WINDOW m AS (PARTITION BY macro_id))"""


@query(with_views(TOKENS, _REWARDED) + f"SELECT rollout_id, pos, {_round('r', 'reward')} FROM rewarded")
def token_reward(spark, sf):
    done = K.token_reward(K.eos_mask(tokens(spark, sf)))
    return done.select("rollout_id", "pos", r6("reward").alias("reward"))


@query(with_views(TOKENS) + f"""SELECT rollout_id, pos, {_round("sum(logp) OVER (PARTITION BY rollout_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", 'g')} FROM tokens""")
def suffix_return(spark, sf):
    done = K.suffix_return(tokens(spark, sf), "logp", "g", width=16)
    return done.select("rollout_id", "pos", r6("g").alias("g"))


@query(with_views(TOKENS, _REWARDED, _FIRST) + f"SELECT rollout_id, pos, {_round('z', 'z')} FROM first")
def masked_standardize(spark, sf):
    rows = K.token_reward(K.eos_mask(tokens(spark, sf)))
    done = K.masked_standardize(rows, "reward", name="z", mask_result=True)
    return done.select("rollout_id", "pos", r6("z").alias("z"))


_ADVANTAGE = with_views(TOKENS, _REWARDED, _FIRST, _RETURNS, _ADV) + f"SELECT rollout_id, pos, {_round('adv', 'advantage')} FROM advantages"


@query(_ADVANTAGE)
def rfpp_advantage(spark, sf):
    done = S.rfpp_advantage(sequences(spark, sf))
    rows = done.select("rollout_id", F.posexplode("advantages").alias("p", "a"))
    return rows.select("rollout_id", (F.col("p") + 1).alias("pos"), r6("a").alias("advantage"))


@query(_ADVANTAGE)
def rfpp_advantage_tokens(spark, sf):
    done = reinforce.rfpp_advantage_tokens(tokens(spark, sf))
    return done.select("rollout_id", "pos", r6("advantage").alias("advantage"))


@query(with_views(TOKENS) + f"SELECT macro_id, count(*) FILTER (valid) AS valid_tokens, {_round('count(*) FILTER (valid) / 8', 'num_items_in_batch')} FROM tokens GROUP BY macro_id")
def valid_tokens(spark, sf):
    done = K.valid_tokens(tokens(spark, sf), 8)
    return done.withColumn("num_items_in_batch", r6("num_items_in_batch"))


_GROUP = """graded AS (SELECT *, (seq_reward - avg(seq_reward) OVER b) / (stddev_samp(seq_reward) OVER b + 1e-4) AS adv
 FROM (SELECT DISTINCT rollout_id, batch_id, seq_reward FROM tokens) WINDOW b AS (PARTITION BY batch_id)),
 scored AS (SELECT t.*, g.adv FROM tokens t JOIN graded g USING (rollout_id, batch_id))"""
_SURROGATE = "least(exp(logp - gen_logp) * adv, least(greatest(exp(logp - gen_logp), 0.8e0), 1.2e0) * adv)"
_TOKEN_LOSS = f"-({_SURROGATE} - 0.04::DOUBLE * (exp(ref_logp - logp) - (ref_logp - logp) - 1))"
_LOSS = with_views(TOKENS, _GROUP) + f"""SELECT batch_id, {_round('avg(m)', 'loss')} FROM (
 SELECT batch_id, rollout_id, sum({_TOKEN_LOSS}) FILTER (valid) / count(*) FILTER (valid) AS m FROM scored GROUP BY batch_id, rollout_id) GROUP BY batch_id"""


def _scored_sequences(spark, sf):
    return G.group_advantage(sequences(spark, sf), by=["batch_id"], reward="seq_reward", spread=["rollout_id"])


def _scored_tokens(spark, sf):
    rows = _scored_sequences(spark, sf)
    zipped = F.arrays_zip(
        F.col("logps").alias("logp"), F.col("gen_logps").alias("gen_logp"), F.col("ref_logps").alias("ref_logp"),
        F.col("valid").alias("valid"),
    )
    kept = ["rollout_id", "batch_id", "macro_id", "advantage"]
    return rows.select(*kept, F.posexplode(zipped).alias("p", "t")).select(*kept, (F.col("p") + 1).alias("pos"), "t.*")


@query(_LOSS)
def grpo_loss(spark, sf):
    return K.grpo_loss(_scored_tokens(spark, sf)).select("batch_id", r6("loss").alias("loss"))


@query(_LOSS)
def grpo_loss_wide(spark, sf):
    return S.grpo_loss_wide(_scored_sequences(spark, sf)).select("batch_id", r6("loss").alias("loss"))


@query(with_views(TOKENS, _GROUP) + f"""SELECT batch_id, {_round('avg(m)', 'loss')} FROM (SELECT batch_id, rollout_id,
 sum(-(adv - 0.04::DOUBLE * (exp(ref_logp - logp) - (ref_logp - logp) - 1))) FILTER (valid) / count(*) FILTER (valid) AS m
 FROM scored GROUP BY batch_id, rollout_id) GROUP BY batch_id""")
def grpo_loss_on_policy(spark, sf):
    return K.grpo_loss(_scored_tokens(spark, sf), gen=None).select("batch_id", r6("loss").alias("loss"))


@query(with_views(TOKENS, _REWARDED, _FIRST, _RETURNS, _ADV) + f"""SELECT batch_id, {_round('sum(l) / any_value(n)', 'loss')} FROM (
 SELECT batch_id, CASE WHEN valid THEN -({_SURROGATE}) ELSE 0 END AS l, count(*) FILTER (valid) OVER (PARTITION BY macro_id) / 8 AS n
 FROM advantages) GROUP BY batch_id""")
def rfpp_loss(spark, sf):
    done = reinforce.rfpp_losses(tokens(spark, sf), 8)
    return done.select("batch_id", r6("loss").alias("loss"))


_ADAPTED = "least(exp(ref_logp - gen_logp) * adv, least(greatest(exp(ref_logp - gen_logp), 0.8e0), 1.2e0) * adv)"


@query(with_views(TOKENS, _GROUP) + f"""SELECT batch_id, {_round('avg(p)', 'loss')}, {_round('avg(p) - 0.5 * avg(a)', 'with_adaptor')} FROM (
 SELECT batch_id, rollout_id, sum({_TOKEN_LOSS}) FILTER (valid) / count(*) FILTER (valid) AS p,
  sum({_ADAPTED}) FILTER (valid) / count(*) FILTER (valid) AS a FROM scored GROUP BY batch_id, rollout_id) GROUP BY batch_id""")
def combined_loss(spark, sf):
    rows = _scored_tokens(spark, sf)
    names = ("ref_logp", "gen_logp", "advantage")
    plain = K.combined_loss(rows, adaptor=names).select("batch_id", r6("loss").alias("loss"))
    both = K.combined_loss(rows, a=0.5, adaptor=names).select("batch_id", r6("loss").alias("with_adaptor"))
    return plain.join(both, "batch_id")


@query(with_views(TOKENS) + f"""SELECT rollout_id, {_round('exp(-sum(logp) FILTER (valid) / (count(*) FILTER (valid) + 1e-8))', 'ppl')} FROM tokens GROUP BY rollout_id""")
def perplexity(spark, sf):
    return K.perplexity(tokens(spark, sf)).select("rollout_id", r6("ppl").alias("ppl"))


@query(with_views(TOKENS) + f"""SELECT batch_id, {_round('covar_pop(logp, gen_logp) / (stddev_pop(logp) * stddev_pop(gen_logp) + 1e-8)', 'pearson')},
 0e0 AS constant FROM tokens GROUP BY batch_id""")
def pearson(spark, sf):
    rows = tokens(spark, sf).withColumn("one", F.lit(1.0))
    usual = K.pearson(rows, "logp", "gen_logp", ["batch_id"]).select("batch_id", r6("pearson").alias("pearson"))
    constant = K.pearson(rows, "logp", "one", ["batch_id"]).select("batch_id", r6("pearson").alias("constant"))
    return usual.join(constant, "batch_id")


_SOFTMAX = """logits AS (SELECT vec_id, label, p, embedding[p+1]::DOUBLE AS x FROM embeddings, range(64) r(p)),
 lse AS (SELECT vec_id, any_value(label) AS label, max(x) + ln(sum(exp(x - m))) AS lse, sum(exp(x - m) * (x - m)) / sum(exp(x - m)) AS mean, max(m) AS top, any_value(x) FILTER (p = 0) AS first
  FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM logits) GROUP BY vec_id)"""


def _logits(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("logits"))


@query(f"""SELECT vec_id, {_round('logits[label + 1] - top - ln(list_sum(list_transform(list_transform(logits, lambda x: x - top), lambda x: exp(x))))', 'logprob')}
 FROM (SELECT vec_id, label, embedding::DOUBLE[] AS logits, list_max(embedding)::DOUBLE AS top FROM embeddings)""")
def token_logprob(spark, sf):
    return _logits(spark, sf).select("vec_id", r6(A.token_logprob("logits", "label")).alias("logprob"))


@query(with_views(_SOFTMAX) + f"SELECT label, {_round('sum(lse - top - mean) / (count(*) + 1e-8)', 'mean_entropy')} FROM lse WHERE first > 0 GROUP BY label")
def mean_entropy(spark, sf):
    rows = _logits(spark, sf).withColumn("valid", F.col("logits")[0] > 0)
    return K.mean_entropy(rows, by=["label"]).select("label", r6("mean_entropy").alias("mean_entropy"))


@query(with_views(_SOFTMAX) + f"SELECT vec_id, {_round('lse', 'lse')} FROM lse")
def logsumexp(spark, sf):
    rows = _logits(spark, sf).select("vec_id", F.posexplode("logits").alias("token", "logit"))
    return K.logsumexp(rows, ["vec_id"]).select("vec_id", r6("lse").alias("lse"))


@query(with_views(IDS) + """SELECT rollout_id, array_to_string(list_concat(answer_ids, list_transform(range(longest - len(answer_ids)), lambda x: -1)), ',') AS right_padded,
 array_to_string(list_concat(list_transform(range(pl - len(prompt_ids)), lambda x: -1), prompt_ids), ',') AS left_padded
 FROM (SELECT *, max(len(answer_ids)) OVER b AS longest, max(len(prompt_ids)) OVER b AS pl FROM ids WINDOW b AS (PARTITION BY batch_id))""")
def pad(spark, sf):
    from rollmill.operators.skew import with_group_stats

    sized = with_group_stats(
        token_ids(spark, sf), ["batch_id"], ["rollout_id"],
        longest=F.max(F.size("answer_ids")), prompt_longest=F.max(F.size("prompt_ids")),
    )
    padded = sized.select(
        "rollout_id", A.pad("answer_ids", "longest", -1).alias("right_padded"),
        A.pad("prompt_ids", "prompt_longest", -1, "left").alias("left_padded"),
    )
    return padded.select("rollout_id", _ids("right_padded"), _ids("left_padded"))


@query(with_views(IDS) + """SELECT rollout_id, array_to_string(list_transform(list_concat(answer_ids, [-1, -1]), lambda x: (x <> -1)::INT), ',') AS mask,
 array_to_string(tids[plen:], ',') AS completion FROM (SELECT *, len(prompt_ids) AS plen FROM ids)""")
def completion_mask(spark, sf):
    rows = token_ids(spark, sf).withColumns(
        {"plen": F.size("prompt_ids"), "input_ids": F.concat("prompt_ids", "answer_ids", F.array(F.lit(-1), F.lit(-1)))}
    )
    done = rows.select(
        "rollout_id", A.completion_mask("input_ids", "plen", -1).alias("mask"),
        A.completion_slice("token_ids", "plen").alias("completion"),
    )
    return done.select("rollout_id", _ids("mask"), _ids("completion"))


@query(with_views(IDS) + """, prompts AS (SELECT batch_id, prompt_ids AS first_prompt FROM ids QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY rollout_id) = 1)
SELECT rollout_id, len(first_prompt)::INT AS plen, array_to_string(list_concat(first_prompt, answer_ids), ',') AS input_ids FROM ids JOIN prompts USING (batch_id)""")
def merge_sequences(spark, sf):
    rows = token_ids(spark, sf)
    first = rows.groupBy("batch_id").agg(F.min_by("prompt_ids", "rollout_id").alias("prompt_ids"))
    done = J.merge_sequences(first, rows.select("rollout_id", "batch_id", "answer_ids"), ["batch_id"], "prompt_ids", "answer_ids")
    return done.select("rollout_id", "plen", _ids("input_ids"))



_MACROS = """macros AS (SELECT batch_id, concat(batch_id % 2, ':', (row_number() OVER (PARTITION BY batch_id % 2 ORDER BY batch_id) - 1) // 3) AS macro_id
 FROM (SELECT DISTINCT vec_id // 8 AS batch_id FROM embeddings))"""
_TAGGED = "tagged AS (SELECT t.* EXCLUDE (macro_id), m.macro_id FROM tokens t JOIN macros m USING (batch_id))"


@query(with_views(TOKENS, _MACROS, _TAGGED, _REWARDED.replace("FROM tokens", "FROM tagged"), _FIRST, _RETURNS, _ADV)
       + f"SELECT macro_id, rollout_id, pos, {_round('adv', 'advantage')} FROM advantages")
def macro_advantages(spark, sf):
    rows = sequences(spark, sf).drop("macro_id").withColumns({"producer": F.col("batch_id") % 2, "arrival": F.col("batch_id")})
    done = reinforce.macro_advantages(rows, 3)
    each = done.select(F.concat_ws(":", "producer", "macro_id").alias("macro_id"), "rollout_id", F.posexplode("advantages").alias("p", "a"))
    return each.select("macro_id", "rollout_id", (F.col("p") + 1).alias("pos"), r6("a").alias("advantage"))
