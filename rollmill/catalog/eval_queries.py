"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.catalog.registry import query, r6
from rollmill.catalog.views import (
    GRADED, OUTCOMES, QUESTIONS, ROLLOUTS, UPLOADS, graded, outcomes, questions, rollouts, table, with_views,
)
from rollmill.functions.text import word_count
from rollmill.operators import evals as E
from rollmill.operators import joins as J
from rollmill.plans import evaluation

_WORDS = r"len(regexp_extract_all(answer, '[^\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))"


def _round(x: str, name: str) -> str:
    return f"round({x}, 6) + 0e0 AS {name}"


def _rounded(df, *names):
    return df.withColumns({n: r6(n) for n in names})


@query(with_views(GRADED) + f"""SELECT count(*) AS samples, {_round('avg(correct::INT)', 'accuracy')},
 {_round('avg(format_ok::INT)', 'format_rate')}, {_round('avg(format_strict::INT)', 'format_rate_strict')} FROM graded""")
def eval_summary(spark, sf):
    return _rounded(E.eval_summary(graded(spark, sf)), "accuracy", "format_rate", "format_rate_strict")


@query(with_views(GRADED) + f"""SELECT {_round('avg(n)', 'avg_words')}, {_round('avg(n) FILTER (correct)', 'avg_corr_ans_words')},
 {_round('avg(n) FILTER (NOT correct)', 'avg_err_ans_words')} FROM (SELECT *, {_WORDS} AS n FROM graded)""")
def length_by_outcome(spark, sf):
    rows = graded(spark, sf).select("correct", word_count("answer").alias("n_words"))
    return _rounded(E.length_by_outcome(rows), "avg_words", "avg_corr_ans_words", "avg_err_ans_words")


@query(with_views(GRADED) + f"""SELECT level, sum(n)::BIGINT AS n, {_round('coalesce(sum(c) / nullif(sum(n), 0), 0)', 'accuracy')} FROM (
 SELECT level, count(*) AS n, sum(correct::INT) AS c FROM graded GROUP BY ROLLUP (level)
 UNION ALL SELECT unnest([1, 2, 3, 4, 5]), 0, 0) GROUP BY level""")
def accuracy_by_level(spark, sf):
    return _rounded(E.accuracy_by_level(graded(spark, sf)), "accuracy")


def _pass(view: str, test: str) -> str:
    ks = "(SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512]) AS k)"
    return f"""counts AS (SELECT q_id, count(*) AS n, sum(correct::INT) AS c FROM {view} GROUP BY q_id),
 scored AS (SELECT q_id, k, 1 - product(greatest(n - c - j, 0)::DOUBLE / (n - j)) AS score
  FROM counts, {ks}, LATERAL (SELECT unnest(range(k)) AS j) WHERE k {test} n GROUP BY q_id, k)"""


_PASS = f"""SELECT k, {_round('avg(score)', 'pass_at_k')}, count(*) AS questions FROM scored GROUP BY k"""


@query(with_views(GRADED, _pass("graded", "<")) + _PASS)
def pass_at_k(spark, sf):
    return _rounded(E.pass_at_k(graded(spark, sf)), "pass_at_k")


@query(with_views(ROLLOUTS, _pass("rollouts", "<=")) + _PASS)
def pass_at_k_inclusive(spark, sf):
    return _rounded(E.pass_at_k(rollouts(spark, sf), inclusive=True), "pass_at_k")


_PER_Q = "per_q AS (SELECT q_id, bool_or(correct) AS any_ok, avg(correct::INT) AS credit, avg(format_ok::INT) AS fmt FROM graded GROUP BY q_id)"


@query(with_views(GRADED, _PER_Q) + f"SELECT count(*) AS questions, {_round('avg(any_ok::INT)', 'accuracy')}, {_round('avg(fmt)', 'format_rate')} FROM per_q")
def any_correct(spark, sf):
    return _rounded(E.any_correct(graded(spark, sf)), "accuracy", "format_rate")


@query(with_views(GRADED, _PER_Q) + f"SELECT count(*) AS questions, {_round('avg(credit)', 'accuracy')}, {_round('avg(fmt)', 'format_rate')} FROM per_q")
def mean_correct(spark, sf):
    return _rounded(E.mean_correct(graded(spark, sf)), "accuracy", "format_rate")


_ANSWERS = """code_answers AS (SELECT q_id, rollout_idx, order_id, count(*) FILTER (status = 'passed') AS num_passed,
 count(*) AS total_tests, bool_and(status = 'passed') AS passed, avg((status <> 'error')::INT) AS ran
 FROM outcomes GROUP BY q_id, rollout_idx, order_id)"""


@query(with_views(OUTCOMES, _ANSWERS) + "SELECT q_id, order_id AS rollout_idx, num_passed, total_tests, passed FROM code_answers")
def outcome_summary(spark, sf):
    return E.outcome_summary(outcomes(spark, sf))


@query(with_views(OUTCOMES, _ANSWERS) + f"SELECT q_id, order_id AS rollout_idx, {_round('num_passed / total_tests + ran', 'correct_reward')} FROM code_answers")
def code_reward(spark, sf):
    return _rounded(E.code_reward(outcomes(spark, sf)), "correct_reward")


@query(with_views(OUTCOMES, _ANSWERS) + f"SELECT count(DISTINCT q_id) AS questions, {_round('sum(num_passed / total_tests) / count(DISTINCT q_id)', 'total_pass_rate')} FROM code_answers")
def total_pass_rate(spark, sf):
    return _rounded(E.total_pass_rate(outcomes(spark, sf)), "total_pass_rate")


@query(with_views(OUTCOMES, _ANSWERS) + f"""SELECT count(*) AS questions, {_round('avg(p1)', 'ps1')}, {_round('avg(p3)', 'ps3')}, {_round('avg(p5)', 'ps5')}
 FROM (SELECT q_id, max((passed AND rollout_idx < 1)::INT) AS p1, max((passed AND rollout_idx < 3)::INT) AS p3,
  max((passed AND rollout_idx < 5)::INT) AS p5 FROM code_answers GROUP BY q_id)""")
def prefix_success(spark, sf):
    answers = E.outcome_summary(outcomes(spark, sf, idx=True))
    return _rounded(E.prefix_success(answers), "ps1", "ps3", "ps5")


@query("""SELECT l_orderkey AS q_id, l_linenumber AS line, l_partkey AS partkey,
 CASE WHEN l_returnflag = 'R' THEN 'error' WHEN l_linestatus = 'O' THEN 'passed' ELSE 'failed' END AS status FROM lineitem""")
def test_status(spark, sf):
    out = F.concat(F.lit("log\n"), F.when(F.col("l_linestatus") == "O", "TEST_PASSED\n").otherwise("TEST_FAILED: x"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("q_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("partkey"),
        E.test_status(F.col("l_returnflag") != "R", out).alias("status"),
    )


@query(with_views(ROLLOUTS) + "SELECT q_id, count(*) FILTER (correct) AS n_correct, count(*) FILTER (format_ok) AS n_format FROM rollouts GROUP BY q_id")
def group_scores(spark, sf):
    rows = rollouts(spark, sf).select(
        "q_id", F.when(F.col("correct"), 1.0).otherwise(-1.0).alias("acc_score"),
        F.when(F.col("format_ok"), 1.0).otherwise(-1.0).alias("format_score"),
    )
    return E.group_scores(rows)


@query(with_views(UPLOADS) + f"""SELECT count(*) AS samples, round(sum(reward), 4) + 0e0 AS elapsed_time_sec,
 {_round('avg(reward)', 'time_per_sample_sec')} FROM uploads""")
def timing_summary(spark, sf):
    rows = table(spark, sf, "events").select(F.col("value").alias("seconds"))
    done = E.timing_summary(rows)
    return done.select("samples", F.round("elapsed_time_sec", 4).alias("elapsed_time_sec"), r6("time_per_sample_sec").alias("time_per_sample_sec"))


_KS, _PS = (1, 2, 4), (1, 3, 5)


def _running() -> str:
    def over(x: str, name: str) -> str:
        return f"{_round(f'sum({x}) OVER w / count(*) OVER w', name)}"

    scores = ", ".join(
        f"CASE WHEN n >= {k} THEN 1 - ({' * '.join(f'(greatest(n - c - {j}, 0)::DOUBLE / nullif(n - {j}, 0))' for j in range(k))}) ELSE 0 END AS s{k}"
        for k in _KS
    )
    firsts = ", ".join(f"max((correct AND rollout_idx < {p})::INT) AS p{p}" for p in _PS)
    return f"""per_q AS (SELECT q_id, count(*) AS n, sum(correct::INT) AS c, bool_or(correct)::INT AS ok, {firsts} FROM rollouts GROUP BY q_id),
 scored AS (SELECT *, {scores} FROM per_q)
SELECT q_id, count(*) OVER w AS questions, (sum(ok) OVER w)::BIGINT AS solved,
 {', '.join(over(f's{k}', f'pass_at_{k}') for k in _KS)}, {', '.join(over(f'p{p}', f'ps{p}') for p in _PS)}
FROM scored WINDOW w AS (ORDER BY q_id ROWS UNBOUNDED PRECEDING)"""


@query("WITH " + ROLLOUTS + ",\n" + _running())
def running_eval(spark, sf):
    done = E.running_eval(rollouts(spark, sf, idx=True), ks=_KS, ps=_PS, q="q_id")
    return _rounded(done, *[f"pass_at_{k}" for k in _KS], *[f"ps{p}" for p in _PS])


@query("""SELECT step, round(sum(n * padded) OVER w / sum(n) OVER w, 6) + 0e0 AS avg_output_token_length,
 round(sum(a) OVER w / sum(n) OVER w, 6) + 0e0 AS acc_correct_ratio, round(sum(f) OVER w / sum(n) OVER w, 6) + 0e0 AS format_correct_ratio
 FROM (SELECT l_orderkey // 2 AS step, count(*) AS n, max(l_quantity)::BIGINT AS padded,
  count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_linestatus = 'O') AS f FROM lineitem GROUP BY 1)
 WINDOW w AS (ORDER BY step ROWS UNBOUNDED PRECEDING)""")
def running_training(spark, sf):
    steps = table(spark, sf, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 2).alias("step")).agg(
        F.count(F.lit(1)).alias("n_sequences"), F.max("l_quantity").cast("bigint").alias("padded_length"),
        F.count_if(F.col("l_returnflag") == "A").alias("n_correct"), F.count_if(F.col("l_linestatus") == "O").alias("n_format"),
    )
    done = E.running_training(steps)
    return _rounded(done, "avg_output_token_length", "acc_correct_ratio", "format_correct_ratio")


@query(with_views(GRADED) + f"""SELECT doc_id // 256 AS part, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (correct) AS correct,
 {_round('any_value(acc)', 'acc')}, any_value(num_samples) AS num_samples FROM (SELECT *, avg(correct::INT) OVER () AS acc, count(*) OVER () AS num_samples
 FROM graded) GROUP BY 1""")
def eval_detail(spark, sf):
    done = E.eval_detail(graded(spark, sf), idx="doc_id", part_size=256)
    listed = F.when(F.size("correct") > 0, F.array_join(F.transform("correct", lambda x: x.cast("string")), ","))
    return done.select("part", listed.alias("correct"), r6("acc").alias("acc"), "num_samples")


@query(with_views(ROLLOUTS, QUESTIONS) + f"""SELECT count(*) AS samples, {_round('avg(correct::INT)', 'accuracy')},
 {_round('avg((line % 3 <> 2 OR true)::INT * format_ok::INT)', 'format_rate')}, {_round('avg(format_ok::INT)', 'format_rate_strict')},
 {_round(f'avg({_WORDS})', 'avg_words')}, {_round(f'avg({_WORDS}) FILTER (correct)', 'avg_corr_ans_words')},
 {_round(f'avg({_WORDS}) FILTER (NOT correct)', 'avg_err_ans_words')} FROM rollouts""".replace("(line % 3 <> 2 OR true)::INT * ", ""))
def evaluate_numeric(spark, sf):
    answers = rollouts(spark, sf).select("q_id", "answer")
    done = evaluation.evaluate_numeric(answers, questions(spark, sf).select("q_id", "gold"))
    return _rounded(done, *[c for c in done.columns if c != "samples"])


_FIRST = "graded_first AS (SELECT q_id, bool_or(correct AND rollout_idx < 2) AS ok FROM graded GROUP BY q_id)"


@query(with_views(GRADED, _FIRST) + """SELECT source AS q_id, kind FROM (SELECT DISTINCT source FROM documents) s,
 LATERAL (SELECT unnest(['failed', 'unattempted']) AS kind) WHERE
 (kind = 'failed' AND source IN (SELECT q_id FROM graded WHERE NOT correct AND format_ok))
 OR (kind = 'unattempted' AND source NOT IN (SELECT q_id FROM graded WHERE NOT format_ok))""")
def retry_candidates(spark, sf):
    asked = table(spark, sf, "documents").select(F.col("source").alias("q_id")).distinct()
    rows = graded(spark, sf).select("q_id", "correct", "format_ok")
    failed = J.retry_candidates(asked, rows.where("format_ok")).withColumn("kind", F.lit("failed"))
    rest = J.unattempted(asked, rows.where("NOT format_ok")).withColumn("kind", F.lit("unattempted"))
    return failed.unionByName(rest)


@query(with_views(ROLLOUTS) + f"""SELECT count(*) AS questions, sum(saved)::BIGINT AS retry_correct, {_round('avg(saved)', 'retry_accuracy')}
 FROM (SELECT q_id, (NOT bool_or(correct AND line <= 2) AND bool_or(correct AND line > 2))::INT AS saved, bool_or(line <= 2) AS had
  FROM rollouts GROUP BY q_id) WHERE had""")
def retry_accuracy(spark, sf):
    rows = rollouts(spark, sf).select("q_id", "line", "correct")
    done = J.retry_accuracy(rows.where("line <= 2"), rows.where("line > 2"))
    return _rounded(done, "retry_accuracy")


@query(with_views(ROLLOUTS) + f"""SELECT level, n, {_round('acc', 'accuracy')}, samples, {_round('total_acc', 'total_accuracy')},
 {_round('fmt', 'format_rate')} FROM (SELECT unnest([1, 2, 3, 4, 5])::INT AS level)
 LEFT JOIN (SELECT 1 + q_id % 4 AS lv, count(*) AS c, avg(correct::INT) AS a FROM rollouts GROUP BY 1) ON lv = level,
 LATERAL (SELECT coalesce(c, 0)::BIGINT AS n, coalesce(a, 0) AS acc),
 (SELECT count(*) AS samples, avg(correct::INT) AS total_acc, avg(format_ok::INT) AS fmt FROM rollouts)""")
def evaluate_math(spark, sf):
    asked = questions(spark, sf).select("q_id", "gold", (1 + F.col("q_id") % 4).cast("int").alias("level"))
    row = evaluation.evaluate_math(rollouts(spark, sf).select("q_id", "answer"), asked)
    each = row.select("samples", "accuracy", "format_rate", "level_accuracy", F.explode("level_counts").alias("level", "n"))
    return each.select(
        "level", "n", r6(F.col("level_accuracy")[F.col("level")]).alias("accuracy"), "samples",
        r6("accuracy").alias("total_accuracy"), r6("format_rate").alias("format_rate"),
    )


@query(with_views(OUTCOMES, _ANSWERS) + f"""SELECT count(*) AS samples, {_round('avg(p1)', 'ps1')}, {_round('avg(p3)', 'ps3')}, {_round('avg(p5)', 'ps5')},
 {_round('avg(share)', 'total_pass_rate')} FROM (SELECT q_id, max((passed AND rollout_idx < 1)::INT) AS p1, max((passed AND rollout_idx < 3)::INT) AS p3,
  max((passed AND rollout_idx < 5)::INT) AS p5, sum(num_passed / total_tests) AS share FROM code_answers GROUP BY q_id)""")
def evaluate_code(spark, sf):
    row = evaluation.evaluate_code(outcomes(spark, sf, idx=True))
    rates = [r6(F.col("pass")[p]).alias(f"ps{p}") for p in (1, 3, 5)]
    return row.select("samples", *rates, r6("total_pass_rate").alias("total_pass_rate"))


@query(with_views(ROLLOUTS) + f"""SELECT count(*) AS samples, sum(n)::BIGINT AS answers, {_round('avg((c > 0)::INT)', 'accuracy')},
 {_round('avg(f)', 'format_rate')}, {_round('avg(f)', 'format_rate_strict')}, {_round('sum(w) / sum(n)', 'avg_words')},
 {_round('sum(w1) / sum(c)', 'avg_corr_ans_words')}, {_round('sum(w - coalesce(w1, 0)) / sum(n - c)', 'avg_err_ans_words')},
 {_round('avg(c / n)', 'pass_at_1')}, {_round('avg(CASE WHEN n >= 2 THEN 1 - greatest(n - c, 0) * greatest(n - c - 1, 0) / (n * nullif(n - 1, 0)) ELSE 0 END)', 'pass_at_2')}
 FROM (SELECT q_id, count(*) AS n, sum(correct::INT) AS c, avg(format_ok::INT) AS f, sum({_WORDS}) AS w, sum({_WORDS}) FILTER (correct) AS w1 FROM rollouts GROUP BY q_id)""")
def evaluate_samples(spark, sf):
    done = evaluation.evaluate_samples(rollouts(spark, sf).select("q_id", "answer"), questions(spark, sf).select("q_id", "gold"))
    done = done.withColumns({f"pass_at_{k}": F.col("pass_at_k")[k] for k in (1, 2)}).drop("pass_at_k")
    return _rounded(done, *[c for c in done.columns if c not in ("samples", "answers")])
