import math
import numpy as np
import pytest
from pyspark.sql import functions as F

from rollmill.functions import arrays as A
from rollmill.operators import sequences as S
from rollmill.operators import tokens as K
from rollmill.plans import reinforce


@pytest.fixture(scope="module")
def drawn(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(30):
        n = int(rng.integers(1, 12))
        valid = [bool(v) for v in rng.random(n) < 0.8] if i % 5 else [False] * n
        logs = [[float(x) for x in -rng.random(n)] for _ in range(3)]
        rows.append((i, i // 5, i // 15, float(rng.choice([2.0, 0.5, -2.0])), *logs, valid))
    schema = ("rollout_id long, batch_id long, macro_id long, seq_reward double, logps array<double>, "
              "gen_logps array<double>, ref_logps array<double>, valid array<boolean>")
    return rows, spark.createDataFrame(rows, schema)


def long_form(df):
    zipped = F.arrays_zip(F.col("logps").alias("logp"), F.col("gen_logps").alias("gen_logp"),
                          F.col("ref_logps").alias("ref_logp"), F.col("valid").alias("valid"))
    keys = [c for c in df.columns if c not in ("logps", "gen_logps", "ref_logps", "valid")]
    return df.select(*keys, F.posexplode(zipped).alias("p", "t")).select(*keys, (F.col("p") + 1).alias("pos"), "t.*")


def by_numpy(rows, beta=0.01, eps=1e-5):
    out = {}
    for macro in {r[2] for r in rows}:
        part = [r for r in rows if r[2] == macro]
        rewards, masks = [], []
        for r in part:
            mask = np.array(r[7])
            last = np.flatnonzero(mask)[-1] if mask.any() else len(mask) - 1
            token = -beta * (np.array(r[5]) - np.array(r[6]))
            token[last] += r[3]
            rewards.append(token * mask)
            masks.append(mask)
        flat = np.concatenate([x[m] for x, m in zip(rewards, masks)])
        scaled = [((x - flat.mean()) / (flat.std() + eps)) * m for x, m in zip(rewards, masks)]
        returns = [np.cumsum(x[::-1])[::-1] for x in scaled]
        flat = np.concatenate([x[m] for x, m in zip(returns, masks)])
        for r, x in zip(part, returns):
            out[r[0]] = (x - flat.mean()) / (flat.std() + eps)
    return out


@pytest.mark.parametrize("hot_rows", [3, 10**6])
def test_token_advantages_by_numpy(drawn, hot_rows):
    rows, df = drawn
    want = by_numpy(rows)
    for r in S.rfpp_advantage(df, hot_rows=hot_rows).collect():
        assert np.allclose(r.advantages, want[r.rollout_id], atol=1e-9)
    for r in reinforce.rfpp_advantage_tokens(long_form(df)).collect():
        assert r.advantage == pytest.approx(want[r.rollout_id][r.pos - 1], abs=1e-9)


def test_grpo_loss_by_numpy(drawn):
    rows, df = drawn
    usable = [r for r in rows if any(r[7])]
    per_batch = {}
    for r in usable:
        cur, gen, ref, mask = np.array(r[4]), np.array(r[5]), np.array(r[6]), np.array(r[7])
        ratio = np.exp(cur - gen)
        gain = np.minimum(ratio * r[3], np.clip(ratio, 0.8, 1.2) * r[3])
        loss = -(gain - 0.04 * (np.exp(ref - cur) - (ref - cur) - 1))
        per_batch.setdefault(r[1], []).append(loss[mask].mean())
    want = {b: np.mean(v) for b, v in per_batch.items()}
    kept = df.where(F.exists("valid", lambda v: v)).withColumn("advantage", F.col("seq_reward"))
    for done in (K.grpo_loss(long_form(kept)), S.grpo_loss_wide(kept)):
        got = {r.batch_id: r.loss for r in done.collect()}
        assert got.keys() == want.keys()
        assert all(got[b] == pytest.approx(want[b]) for b in want)


def test_suffix_sum_starts_with_the_total(drawn):
    rows, df = drawn
    done = K.suffix_return(long_form(df), "logp", "g", width=4).where("pos = 1").collect()
    assert all(r.g == pytest.approx(sum(rows[r.rollout_id][4])) for r in done)


def test_worked_values(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("v")).first().v

    assert value(A.kl_k3(F.lit(-1.0), F.lit(-1.0))) == 0
    gen = F.lit(0.0)
    cur = F.log(F.lit(1.5))
    assert value(A.clipped_surrogate(cur, gen, F.lit(1.0))) == pytest.approx(1.2)
    assert value(A.clipped_surrogate(cur, gen, F.lit(-1.0))) == pytest.approx(-1.5)
    marks = spark.createDataFrame([([True, True, False],), ([False] * 3,)], "v array<boolean>")
    assert [r.e for r in marks.select(S.last_valid("v").alias("e")).collect()] == [1, 2]
    rows = spark.createDataFrame([(1, p, float(p)) for p in (1, 2, 3)], "rollout_id int, pos int, reward double")
    assert sorted(r["return"] for r in K.suffix_return(rows).collect()) == [3.0, 5.0, 6.0]


def test_kl_is_never_negative(drawn):
    _, df = drawn
    assert long_form(df).where(A.kl_k3("logp", "ref_logp") < 0).isEmpty()


def test_logits_by_numpy(spark):
    rng = np.random.default_rng(1)
    logits = rng.normal(0, 300, (20, 50))
    df = spark.createDataFrame([(i, [float(x) for x in row], i) for i, row in enumerate(logits)], "pos long, logits array<double>, token int")
    top = logits.max(1, keepdims=True)
    lse = (top + np.log(np.exp(logits - top).sum(1, keepdims=True)))[:, 0]
    probs = np.exp(logits - lse[:, None])
    entropy = -(probs * np.where(probs > 0, logits - lse[:, None], 0)).sum(1)
    got = df.select("pos", A.token_logprob("logits", "token").alias("lp"), A.entropy_array("logits").alias("h")).collect()
    for r in got:
        assert r.lp == pytest.approx(logits[r.pos, r.pos] - lse[r.pos])
        assert r.h == pytest.approx(entropy[r.pos], abs=1e-9)
    rows = df.select("pos", F.posexplode("logits").alias("token", "logit"))
    for step in (1, 7, 300):
        done = K.logsumexp(rows, ["pos"], step=step).collect()
        assert len(done) == len(lse)
        for r in done:
            assert r.lse == pytest.approx(lse[r.pos], rel=1e-12)


def test_logsumexp_over_a_wide_range(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(2)
    groups = {i: rng.uniform(-1e4, 1e4, 200).tolist() for i in range(5)}
    groups |= {10: [0.0] * 1000, 11: [-1e300, 1e300], 12: [None, None], 13: [-inf, -inf], 14: [-inf, 1.5, None], 15: [inf, 1.0], 16: [nan, 2.0, inf]}
    groups |= {17: [599.999, 600.001, -5.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "pos int, logit double").repartition(3)
    got = {r.pos: r.lse for r in K.logsumexp(rows, ["pos"]).collect()}
    for k, vs in groups.items():
        known = [v for v in vs if v is not None]
        if not known:
            assert got[k] is None
        elif any(math.isnan(v) for v in known):
            assert math.isnan(got[k])
        else:
            want = np.logaddexp.reduce(known)
            assert got[k] == want or got[k] == pytest.approx(want, rel=1e-12)


def test_padding_and_masks(spark):
    df = spark.createDataFrame([([5, 6, 7, 9, 9],)], "ids array<int>")
    row = df.select(
        A.pad("ids", F.lit(7), 9).alias("r"), A.pad("ids", F.lit(7), 9, "left").alias("l"), A.pad("ids", F.lit(2), 9).alias("same"),
        A.completion_mask("ids", F.lit(2), 9).alias("m"), A.completion_slice("ids", F.lit(2)).alias("s"),
    ).first()
    assert (row.r, row.l) == ([5, 6, 7, 9, 9, 9, 9], [9, 9, 5, 6, 7, 9, 9])
    assert row.same == [5, 6, 7, 9, 9] and row.m == [1, 0, 0] and row.s == [6, 7, 9, 9]
    with pytest.raises(ValueError):
        A.pad("ids", F.lit(2), 9, "top")


def test_suffix_sums_of_lists(spark):
    """NULL entries as in the long form, rows of all lengths in one batch."""
    rng = np.random.default_rng(4)
    rows = [[1.0, None, 2.0], [1.0, None], [None], [], None, [5.0]]
    rows += [[None if rng.random() < 0.2 else float(x) for x in rng.normal(size=n)] for n in rng.integers(0, 70, 200)]
    df = spark.createDataFrame(list(enumerate(rows)), "rollout_id long, v array<double>").coalesce(1)
    got = {r.rollout_id: r.s for r in df.select("rollout_id", A.suffix_sums("v").alias("s")).collect()}
    assert got[0] == [3.0, 2.0, 2.0] and got[1] == [1.0, None] and got[2] == [None] and got[3] == [] and got[4] is None
    for i, row in enumerate(rows):
        for j in range(len(row or [])):
            known = [x for x in row[j:] if x is not None]
            assert got[i][j] is None if not known else got[i][j] == pytest.approx(sum(known))
    long = K.suffix_return(df.select("rollout_id", F.posexplode("v").alias("pos", "reward")))
    for r in long.collect():
        want = got[r.rollout_id][r.pos]
        assert r["return"] is None if want is None else r["return"] == pytest.approx(want)


def test_token_advantages_with_null_log_probs(spark):
    from rollmill.plans.reinforce import rfpp_advantage_tokens

    rng = np.random.default_rng(6)
    rows = []
    for i in range(12):
        n = 3 + i % 4
        gen = [None if i % 3 == 0 and j == 1 else float(-rng.random()) for j in range(n)]
        rows.append((i, i % 2, float(i % 3), gen, [float(-rng.random()) for _ in range(n)], [j < n - i % 2 for j in range(n)]))
    schema = "rollout_id long, macro_id long, seq_reward double, gen_logps array<double>, ref_logps array<double>, valid array<boolean>"
    df = spark.createDataFrame(rows, schema)
    wide = {r.rollout_id: r.advantages for r in S.rfpp_advantage(df).collect()}
    zipped = F.arrays_zip(F.col("gen_logps").alias("gen_logp"), F.col("ref_logps").alias("ref_logp"), F.col("valid").alias("valid"))
    long = df.select("rollout_id", "macro_id", "seq_reward", F.posexplode(zipped).alias("pos", "z")).select(
        "rollout_id", "macro_id", "seq_reward", "pos", "z.*"
    )
    done = rfpp_advantage_tokens(long).collect()
    assert len(done) == sum(len(r[3]) for r in rows)
    for r in done:
        want = wide[r.rollout_id][r.pos]
        assert r.advantage is None if want is None else r.advantage == pytest.approx(want)
