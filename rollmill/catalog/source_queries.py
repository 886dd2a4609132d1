"""Tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rollmill.catalog.registry import query, r6
from rollmill.catalog.views import (
    CODE_TASKS, EXCHANGES, GRADED, IDS, QUESTIONS, ROLLOUTS, TOKENS,
    code_tasks, exchanges, graded, questions, rollouts, table, token_ids, tokens, with_views,
)
from rollmill.functions.text import think_format, think_format_strict
from rollmill.operators.batching import draw_order
from rollmill.operators.evals import eval_summary
from rollmill.operators.tokens import align_logps
from rollmill.session import run_dir
from rollmill.sources import batches, cursor, datasets, logs


def _md5(c: str):
    return F.md5(F.col(c).cast("binary"))


def _split():
    return F.when(F.col("correct"), "train").otherwise("test").alias("split")


def _both_splits(spark, path, read):
    parts = [read(spark, path, s).withColumn("split", F.lit(s)) for s in ("train", "test")]
    return parts[0].unionByName(parts[1])


@query(with_views(GRADED) + """SELECT doc_id AS idx, md5(answer) AS question_md5, regexp_extract(answer_raw, '(\\d+)\\n$', 1) AS gold,
 CASE WHEN correct THEN 'train' ELSE 'test' END AS split FROM graded""")
def read_questions(spark, sf):
    path = run_dir(spark, "questions")
    clean = F.concat(F.replace("answer", F.lit("#"), F.lit("")), F.lit("#### "), "doc_id", F.lit("\n"))
    rows = graded(spark, sf).select(
        F.col("doc_id").alias("idx"), F.col("answer").alias("question"), clean.alias("answer"), _split()
    )
    datasets.write_dataset(rows, path)
    return _both_splits(spark, path, datasets.read_questions).select(
        "idx", _md5("question").alias("question_md5"), "gold", "split"
    )


@query(with_views(GRADED) + """SELECT doc_id AS idx, md5(answer) AS problem_md5, level, concat('x = ', doc_id) AS gold,
 CASE WHEN correct THEN 'train' ELSE 'test' END AS split FROM graded""")
def read_math(spark, sf):
    path = run_dir(spark, "math")
    rows = graded(spark, sf).select(
        F.col("doc_id").alias("idx"), F.col("answer").alias("problem"),
        F.concat(F.lit(" \n\tx = "), "doc_id", F.lit(" \n")).alias("answer"), "level", _split(),
    )
    datasets.write_dataset(rows, path)
    return _both_splits(spark, path, datasets.read_math).select(
        "idx", _md5("problem").alias("problem_md5"), "level", "gold", "split"
    )


@query(with_views(CODE_TASKS) + """SELECT idx, text, test_setup_code, array_to_string(test_list, '|') AS tests,
 CASE WHEN test_setup_code = '' THEN 'train' ELSE 'test' END AS split FROM code_tasks""")
def read_code_tasks(spark, sf):
    path = run_dir(spark, "code")
    split = F.when(F.col("test_setup_code") == "", "train").otherwise("test")
    datasets.write_dataset(code_tasks(spark, sf).drop("answer").withColumn("split", split), path)
    return _both_splits(spark, path, datasets.read_code_tasks).select(
        "idx", "text", "test_setup_code", F.array_join("test_list", "|").alias("tests"), "split"
    )


@query(with_views(GRADED) + "SELECT md5(answer) AS question_md5, concat('\\boxed{', doc_id, '}') AS answer_detail FROM graded")
def read_qa_json(spark, sf):
    path = run_dir(spark, "qa-json")
    item = F.struct(F.col("answer").alias("question"), F.concat(F.lit("\\boxed{"), "doc_id", F.lit("}")).alias("answer_detail"))
    arrays = graded(spark, sf).groupBy(F.floor(F.col("doc_id") / 64).alias("file")).agg(
        F.to_json(F.collect_list(item)).alias("value")
    )
    arrays.write.partitionBy("file").text(path)
    return datasets.read_qa_json(spark, path).select(_md5("question").alias("question_md5"), "answer_detail")


@query(with_views(QUESTIONS) + "SELECT gold AS split, count(*) AS n FROM questions GROUP BY gold")
def write_dataset(spark, sf):
    path = run_dir(spark, "dataset")
    rows = questions(spark, sf).withColumn("split", F.col("gold"))
    datasets.write_dataset(rows, path)
    return spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query(with_views(EXCHANGES) + """SELECT conv_id, turn, md5(concat('You are ', conv_id, chr(10), chr(10), (SELECT max(text) FROM benchmark), chr(10))) AS system_md5,
 concat('You are ', conv_id) AS unchanged FROM exchanges""")
def with_skill_prompt(spark, sf):
    path = run_dir(spark, "skill")
    table(spark, sf, "benchmark").agg(F.max("text")).write.text(path)
    rows = exchanges(spark, sf).select("conv_id", "turn", F.concat(F.lit("You are "), "conv_id").alias("system"))
    same = datasets.with_skill_prompt(rows.withColumn("unchanged", F.col("system")), path + "-missing", "unchanged")
    done = datasets.with_skill_prompt(same, path)
    return done.select("conv_id", "turn", _md5("system").alias("system_md5"), "unchanged")


@query(with_views(ROLLOUTS) + """, first_ones AS (SELECT DISTINCT q_id FROM rollouts ORDER BY q_id LIMIT 50),
 so_far AS (SELECT q_id, round(avg(s1) OVER w, 6) + 0e0 AS pass_at_1, round(avg(s2) OVER w, 6) + 0e0 AS pass_at_2 FROM (
   SELECT q_id, c / n AS s1, CASE WHEN n >= 2 THEN 1 - greatest(n - c, 0) * greatest(n - c - 1, 0) / (n * nullif(n - 1, 0)) ELSE 0 END AS s2
   FROM (SELECT q_id, count(*) AS n, sum(correct::INT) AS c FROM rollouts WHERE q_id IN (FROM first_ones) GROUP BY q_id))
  WINDOW w AS (ORDER BY q_id ROWS UNBOUNDED PRECEDING))
SELECT q_id AS q_idx, concat('What is ', q_id, ' modulo 97?') AS question, gold, pass_at_1, pass_at_2, rollout_idx, answer,
 CASE WHEN correct THEN 1 ELSE -1 END::DOUBLE AS correct_reward, CASE WHEN format_ok THEN 1.25 ELSE -1 END::DOUBLE AS format_reward,
 CASE WHEN format_ok THEN 1 ELSE -1 END::DOUBLE AS format_reward_strict FROM rollouts JOIN so_far USING (q_id)""")
def write_rollouts(spark, sf):
    path = run_dir(spark, "rollouts")
    rows = rollouts(spark, sf, idx=True).drop("gold").join(questions(spark, sf), "q_id").withColumns(
        {"format_ok": think_format("answer"), "format_strict": think_format_strict("answer")}
    )
    logs.write_rollouts(rows.withColumnRenamed("q_id", "q_idx"), path, 50, ks=(1, 2))
    saved = spark.read.json(path)
    scores = [r6(F.col("pass_at_k")[k]).alias(f"pass_at_{k}") for k in ("1", "2")]
    return saved.select("q_idx", "question", "gold", *scores, F.inline("results"))


@query(with_views(GRADED) + """SELECT doc_id AS idx, round(acc, 6) + 0e0 AS acc, num_samples, 1::BIGINT AS records FROM (
 SELECT *, avg(correct::INT) OVER () AS acc, count(*) OVER () AS num_samples FROM graded) WHERE correct""")
def write_eval_detail(spark, sf):
    path = run_dir(spark, "detail")
    logs.write_eval_detail(graded(spark, sf), path, idx="doc_id", part_size=256)
    saved = spark.read.json(path)
    records = saved.agg(F.count(F.lit(1))).scalar()
    return saved.select(F.explode("correct").alias("idx"), r6("acc").alias("acc"), "num_samples", records.alias("records"))


@query(with_views(GRADED) + """SELECT model, split, info, count(*) AS samples, round(avg(correct::INT), 6) AS accuracy FROM graded,
 (VALUES ('m1', 'test', NULL), ('m2', 'train', 'second run')) r(model, split, info) GROUP BY model, split, info""")
def append_eval_result(spark, sf):
    path = run_dir(spark, "results")
    summary = eval_summary(graded(spark, sf))
    logs.append_eval_result(summary, path, model="m1", split="test")
    logs.append_eval_result(summary, path, info="second run", model="m2", split="train")
    return spark.read.json(path).select("model", "split", "info", "samples", r6("accuracy").alias("accuracy"))


@query(with_views(ROLLOUTS) + """SELECT q, a, answer, acc_score, format_score, count(*) AS n FROM (
 SELECT concat('What is ', q_id, ' modulo 97?') AS q, gold AS a, answer, CASE WHEN correct THEN 1 ELSE -1 END::DOUBLE AS acc_score,
  CASE WHEN format_ok THEN 1 ELSE -1 END::DOUBLE AS format_score FROM rollouts, range(2)) GROUP BY ALL""")
def append_generation_log(spark, sf):
    path = run_dir(spark, "generations")
    rows = rollouts(spark, sf).select(
        F.concat(F.lit("What is "), "q_id", F.lit(" modulo 97?")).alias("question"), "gold", "answer",
        F.when(F.col("correct"), 1.0).otherwise(-1.0).alias("acc_score"),
        F.when(F.col("format_ok"), 1.0).otherwise(-1.0).alias("format_score"),
    )
    assert logs.read_generation_log(spark, path).isEmpty()
    logs.append_generation_log(rows, path)
    rows.limit(1).select(F.lit('{"question": {"Q": "cut of')).write.mode("append").text(path)
    logs.append_generation_log(rows, path)
    seen = logs.read_generation_log(spark, path)
    return seen.groupBy(F.col("question.Q").alias("q"), F.col("question.A").alias("a"), "answer", "acc_score", "format_score").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(with_views(ROLLOUTS) + """SELECT q_id, answer, count(*) AS n FROM (SELECT q_id, answer FROM rollouts WHERE correct
 UNION ALL SELECT q_id, answer FROM rollouts WHERE NOT correct) GROUP BY ALL""")
def append_history(spark, sf):
    rows = rollouts(spark, sf).select("q_id", "answer", "correct")
    both = logs.append_history(rows.where("correct"), rows.where("NOT correct"))
    return both.groupBy("q_id", "answer").agg(F.count(F.lit(1)).alias("n"))


@query(with_views(ROLLOUTS) + """SELECT unnest(string_split(concat('--------------------', chr(10), answer), chr(10))) AS line, count(*) AS n
 FROM rollouts WHERE rollout_idx = 0 AND q_id % 5 = 0 GROUP BY 1
 UNION ALL SELECT '', count(*) FROM rollouts WHERE rollout_idx = 0 AND q_id % 5 = 0""")
def sample_log(spark, sf):
    path = run_dir(spark, "samples")
    logs.write_sample_log(rollouts(spark, sf, idx=True), path, every=5, iteration="q_id", first=("rollout_idx",))
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, draw_no, 700::BIGINT AS step FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws(':', '5', o_orderkey))) AS draw_no FROM orders)
 WHERE draw_no > 1234""")
def after_cursor(spark, sf):
    path = run_dir(spark, "cursor")
    cursor.write_cursor(spark, path, 1234, 700)
    saved = cursor.read_cursor(spark, path)
    ordered = draw_order(table(spark, sf, "orders").select("o_orderkey"), 5, ["o_orderkey"])
    return cursor.after_cursor(ordered, saved).withColumn("step", saved.select(F.max("step")).scalar())


@query(with_views(IDS) + """SELECT rollout_id AS batch_id, len(prompt_ids)::INT AS plen, round(rollout_id / 7, 6) AS rmean,
 array_to_string(answer_ids, ',') AS first_input, label::DOUBLE AS reward, label % 2 = 0 AS has_gen FROM ids""")
def write_batches(spark, sf):
    path = run_dir(spark, "batches")
    rows = token_ids(spark, sf).select(
        F.col("rollout_id").alias("batch_id"), F.size("prompt_ids").alias("plen"), (F.col("rollout_id") / 7).alias("rmean"),
        F.array("answer_ids").alias("inputs"), F.array(F.col("label").cast("double")).alias("rewards"),
        F.when(F.col("label") % 2 == 0, F.array(F.transform("answer_ids", lambda x: -x / 1000.0))).alias("gen_logps"),
    )
    batches.write_batches(rows, path)
    return batches.read_batches(spark, path).select(
        "batch_id", "plen", r6("rmean").alias("rmean"),
        F.array_join(F.transform(F.col("inputs")[0], lambda x: x.cast("string")), ",").alias("first_input"),
        F.col("rewards")[0].alias("reward"), F.col("gen_logps").isNotNull().alias("has_gen"),
    )


@query(with_views(TOKENS) + "SELECT rollout_id, pos, logp, gen_logp, ref_logp FROM tokens")
def write_token_table(spark, sf):
    """Three bucketed tables, aligned without a shuffle."""
    rows, names = tokens(spark, sf), []
    for c in ("logp", "gen_logp", "ref_logp"):
        names.append(f"tokens_{uuid.uuid4().hex}")
        batches.write_token_table(rows.select("rollout_id", "pos", c), names[-1], 16)
    return align_logps(*[spark.table(n) for n in names])
