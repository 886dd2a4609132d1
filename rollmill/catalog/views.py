"""Inputs of the registered queries, derived from the test tables, in Spark and in SQL.

Each view has one Spark function and one SQL common table expression of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.functions.text import TOOL_STOP_SENTENCE
from rollmill.operators.scan import bucket_hot_groups, ranked, width_bucket


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def numbered(df: DataFrame, by: list[str], order_by: list[str], bucket, name: str = "rollout_idx") -> DataFrame:
    """Zero-based position in the group; hot groups are numbered in buckets."""
    marked, cut = bucket_hot_groups(df, by, bucket)
    placed = ranked(marked, by, order_by, cut, name)
    return placed.withColumn(name, F.col(name) - 1).drop("_is_hot")


# ----- answers to questions, from lineitem ------------------------------------------------------

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]

ROLLOUT_ID = ["line", "partkey", "suppkey"]


def rollouts(spark: SparkSession, sf: str, idx: bool = False) -> DataFrame:
    """Answers with their gold number; `idx` adds the position of the answer in its question."""
    li = table(spark, sf, "lineitem")
    if idx:
        fine = F.col("l_linenumber") * F.lit(2**40) + F.floor(F.col("l_partkey") / 64)
        li = numbered(li, ["l_orderkey"], _ORDER, fine)
    right = F.col("l_returnflag") == "A"
    gap = F.expr("CASE WHEN l_linestatus='F' THEN 'x' WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 3 = 1 THEN chr(10) ELSE ' ' END")
    said = (F.col("l_orderkey") % 97 + F.when(right, 0).otherwise(1)).cast("string")
    acc = F.when(right, 1.0).otherwise(-1.0)
    fmt = F.when(F.col("l_linestatus") == "O", 1.25).otherwise(-1.0)
    return li.select(
        F.col("l_orderkey").alias("q_id"),
        *(["rollout_idx"] if idx else []),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        (F.col("l_orderkey") % 97).cast("string").alias("gold"),
        F.concat(
            F.lit("<think>line "), F.col("l_linenumber").cast("string"), F.lit("</think>"), gap,
            F.lit("<answer>"), said, F.lit("</answer>"),
        ).alias("answer"),
        right.alias("correct"),
        (F.col("l_linestatus") == "O").alias("format_ok"),
        (acc + fmt).alias("reward"),
    )


ROLLOUTS = """rollouts AS (
 SELECT l_orderkey AS q_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,
    l_extendedprice,l_quantity,l_shipdate) - 1 AS rollout_idx,
  l_linenumber AS line, l_partkey AS partkey, l_suppkey AS suppkey,
  CAST(l_orderkey % 97 AS VARCHAR) AS gold,
  concat('<think>line ', CAST(l_linenumber AS VARCHAR), '</think>',
   CASE WHEN l_linestatus='F' THEN 'x' WHEN l_linenumber % 3 = 0 THEN ''
        WHEN l_linenumber % 3 = 1 THEN chr(10) ELSE ' ' END,
   '<answer>', CAST(l_orderkey % 97 + CASE WHEN l_returnflag='A' THEN 0 ELSE 1 END AS VARCHAR),
   '</answer>') AS answer,
  l_returnflag='A' AS correct, l_linestatus='O' AS format_ok,
  CAST(CASE WHEN l_returnflag='A' THEN 1 ELSE -1 END + CASE WHEN l_linestatus='O' THEN 1.25 ELSE -1 END AS DOUBLE) AS reward
 FROM lineitem)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per order that has answers, with the raw gold text."""
    keys = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("q_id")).distinct()
    return keys.select(
        "q_id",
        F.concat(F.lit("What is "), F.col("q_id"), F.lit(" modulo 97?")).alias("question"),
        (F.col("q_id") % 97).cast("string").alias("gold"),
    )


QUESTIONS = """questions AS (
 SELECT DISTINCT l_orderkey AS q_id, concat('What is ', l_orderkey, ' modulo 97?') AS question,
  CAST(l_orderkey % 97 AS VARCHAR) AS gold FROM lineitem)"""

# ----- math answers in LaTeX, from lineitem ------------------------------------------------------

_MATH_ANSWER = r"""CASE {line} % 6
  WHEN 0 THEN concat('so \boxed{{', {part}, '}} and \boxed{{\frac{{', {supp}, '}}{{', {line} + 1, '}}}}')
  WHEN 1 THEN concat('thus $x=', {part}, '$ then $ \left( ', {line}, ' \right) $ {{a}}')
  WHEN 2 THEN concat('<answer> \boxed{{', {part} % 5, '}} </answer>')
  WHEN 3 THEN concat('<answer>$', {part} % 5, '.50$</answer> 7')
  WHEN 4 THEN concat('it is -', {part} % 50, ' or -', {line}, '/', {part} % 7 + 1)
  ELSE concat('<answer> \text{{cm}} \frac {{ ', {supp}, ' }}{{', {line}, '}}</answer>\boxed{{x{{y{{z}}}}}}') END"""
_MATH_GOLD = r"""CASE {line} % 6
  WHEN 0 THEN concat('\frac{{', {supp}, '}}{{', {line} + 1, '}}')
  WHEN 1 THEN concat('(', {line}, ')')
  WHEN 2 THEN concat(' ', {part} % 7, ' ')
  WHEN 3 THEN concat({part} % 7, '.5')
  WHEN 4 THEN concat('-', {line}, '/', {supp} % 7 + 1)
  ELSE concat('cm(', {supp}, ')/(', {line}, ')') END"""
_NAMES = {"line": "l_linenumber", "part": "l_partkey", "supp": "l_suppkey"}


def math_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in mixed notations, with a gold answer that agrees for a part of them."""
    # Backslashes are doubled because Spark SQL strings treat them as escapes.
    answer = _MATH_ANSWER.format(**_NAMES).replace("\\", "\\\\")
    gold = _MATH_GOLD.format(**_NAMES).replace("\\", "\\\\")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("q_id"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"),
        F.expr(answer).alias("answer"), F.expr(gold).alias("gold"),
    )


MATH_ANSWERS = f"""math_answers AS (
 SELECT l_orderkey AS q_id, l_linenumber AS line, l_partkey AS partkey, l_suppkey AS suppkey,
  {_MATH_ANSWER.format(**_NAMES)} AS answer, {_MATH_GOLD.format(**_NAMES)} AS gold
 FROM lineitem)"""

# ----- graded answers, from documents and labels -------------------------------------------------


def graded(spark: SparkSession, sf: str, idx: bool = False) -> DataFrame:
    """Documents as answers to the question named by their source, graded by their labels."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    if idx:
        docs = numbered(docs, ["source"], ["doc_id"], width_bucket("doc_id"))
    level = F.expr("CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 END")
    return docs.select(
        "doc_id",
        F.col("source").alias("q_id"),
        *(["rollout_idx"] if idx else []),
        F.col("text").alias("answer"),
        F.concat("text", F.lit("#### "), F.col("doc_id"), F.lit("\n")).alias("answer_raw"),
        (F.col("quality") == 1).alias("correct"),
        (F.col("toxic") == 0).alias("format_ok"),
        ((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("format_strict"),
        level.alias("level"),
    )


GRADED = """graded AS (
 SELECT d.doc_id, source AS q_id, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) - 1 AS rollout_idx,
  text AS answer, concat(text, '#### ', d.doc_id, chr(10)) AS answer_raw,
  quality = 1 AS correct, toxic = 0 AS format_ok, toxic = 0 AND quality = 1 AS format_strict,
  CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 END AS level
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

# ----- token log-probs, from embeddings -----------------------------------------------------------


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """One row per answer with aligned log-prob arrays."""
    return sequence_rows(table(spark, sf, "embeddings"))


def sequence_rows(e: DataFrame) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    n = F.size("embedding")
    return e.select(
        F.col("vec_id").alias("rollout_id"),
        F.floor(F.col("vec_id") / 8).alias("batch_id"),
        F.floor(F.col("vec_id") / 64).alias("macro_id"),
        "label",
        F.transform(v, lambda x: -F.abs(x)).alias("logps"),
        F.transform(F.reverse(v), lambda x: -F.abs(x)).alias("gen_logps"),
        F.transform(F.concat(F.slice(v, F.lit(2), n), F.slice(v, 1, 1)), lambda x: -F.abs(x)).alias("ref_logps"),
        F.expr("CAST(CASE label % 3 WHEN 0 THEN 2 WHEN 1 THEN 0.5 ELSE -2 END AS DOUBLE)").alias("seq_reward"),
        F.transform(F.sequence(F.lit(1), n), lambda p: p <= 16 + 4 * F.col("label")).alias("valid"),
    )


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """One row per answer and position."""
    zipped = F.arrays_zip(
        F.col("logps").alias("logp"), F.col("gen_logps").alias("gen_logp"),
        F.col("ref_logps").alias("ref_logp"), F.col("valid").alias("valid"),
    )
    return (
        sequences(spark, sf)
        .select("rollout_id", "batch_id", "macro_id", "label", "seq_reward", F.posexplode(zipped).alias("p", "t"))
        .select("rollout_id", "batch_id", "macro_id", "label", "seq_reward", (F.col("p") + 1).alias("pos"), "t.*")
    )


TOKENS = """tokens AS (
 SELECT vec_id AS rollout_id, vec_id//8 AS batch_id, vec_id//64 AS macro_id, label, CAST(p+1 AS INT) AS pos,
  -abs(embedding[p+1]::DOUBLE) AS logp, -abs(embedding[64-p]::DOUBLE) AS gen_logp,
  -abs(embedding[(p+1)%64+1]::DOUBLE) AS ref_logp,
  CAST(CASE label%3 WHEN 0 THEN 2 WHEN 1 THEN 0.5 ELSE -2 END AS DOUBLE) AS seq_reward,
  p+1 <= 16+4*label AS valid
 FROM embeddings, range(64) r(p))"""


def token_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token id arrays of varying length: a prompt and a padded answer."""
    e = table(spark, sf, "embeddings")
    ids = F.transform("embedding", lambda x: F.floor(F.abs(x) * 1000).cast("int"))
    return e.select(
        F.col("vec_id").alias("rollout_id"), F.floor(F.col("vec_id") / 8).alias("batch_id"), "label",
        F.slice(ids, F.lit(1), 4 + F.col("label")).alias("prompt_ids"),
        F.slice(ids, F.lit(20), 16 + 2 * F.col("label")).alias("answer_ids"),
        ids.alias("token_ids"),
    )


IDS = """ids AS (
 SELECT *, tids[1:4+label] AS prompt_ids, tids[20:35+2*label] AS answer_ids FROM (
  SELECT vec_id AS rollout_id, vec_id//8 AS batch_id, label,
   list_transform(embedding, lambda x: CAST(floor(abs(x)*1000::FLOAT) AS INT)) AS tids FROM embeddings))"""

# ----- uploads, from events -----------------------------------------------------------------------


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("q"), F.col("event_type").alias("answer"),
        F.col("value").alias("reward"), F.col("event_id").alias("arrival"),
    )


UPLOADS = """uploads AS (
 SELECT CAST(user_id AS VARCHAR) AS q, event_type AS answer, value AS reward, event_id AS arrival FROM events)"""

# ----- code tasks and test outcomes, from part, orders and lineitem ---------------------------------


def code_tasks(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("idx"),
        F.col("p_name").alias("text"),
        F.when(F.col("p_partkey") % 3 == 0, "import math").otherwise("").alias("test_setup_code"),
        F.array(
            F.concat(F.lit("assert f_"), "p_partkey", F.lit("("), "p_size", F.lit(") == "), "p_size"),
            F.concat(F.lit("assert g('"), "p_brand", F.lit("') == \""), "p_type", F.lit('"')),
            F.concat(F.lit("f_"), "p_partkey", F.lit("('"), "p_type", F.lit("')")),
        ).alias("test_list"),
        F.when(
            F.col("p_partkey") % 4 == 0, F.concat(F.lit("no code, size "), "p_size")
        ).otherwise(
            F.concat(F.lit("Plan.\n```python\ndef f_"), "p_partkey", F.lit("(x):\n    return "), "p_size",
                     F.lit("\n\n```\nError! "), F.repeat(F.lit("```python Error!"), F.col("p_size") % 4))
        ).alias("answer"),
    )


CODE_TASKS = """code_tasks AS (
 SELECT p_partkey AS idx, p_name AS text,
  CASE WHEN p_partkey % 3 = 0 THEN 'import math' ELSE '' END AS test_setup_code,
  [concat('assert f_', p_partkey, '(', p_size, ') == ', p_size),
   concat('assert g(''', p_brand, ''') == "', p_type, '"'),
   concat('f_', p_partkey, '(''', p_type, ''')')] AS test_list,
  CASE WHEN p_partkey % 4 = 0 THEN concat('no code, size ', p_size)
   ELSE concat('Plan.', chr(10), '```python', chr(10), 'def f_', p_partkey, '(x):', chr(10), '    return ', p_size,
    chr(10), chr(10), '```', chr(10), 'Error! ', repeat('```python Error!', p_size % 4)) END AS answer
 FROM part)"""


def outcomes(spark: SparkSession, sf: str, idx: bool = False) -> DataFrame:
    """Test outcomes: customers as tasks, their orders as code answers, lines as tests."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    if idx:
        orders = numbered(orders, ["o_custkey"], ["o_orderkey"], width_bucket("o_orderkey"))
    status = F.expr("CASE l_returnflag WHEN 'A' THEN 'passed' WHEN 'N' THEN 'failed' ELSE 'error' END")
    joined = orders.join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(
        F.col("o_custkey").alias("q_id"),
        (F.col("rollout_idx") if idx else F.col("o_orderkey").alias("rollout_idx")),
        F.col("l_linenumber").alias("test_case"), status.alias("status"),
    )


OUTCOMES = """outcomes AS (
 SELECT o_custkey AS q_id, rollout_idx, o_orderkey AS order_id, l_linenumber AS test_case,
  CASE l_returnflag WHEN 'A' THEN 'passed' WHEN 'N' THEN 'failed' ELSE 'error' END AS status
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rollout_idx FROM orders) o
 JOIN lineitem ON o_orderkey = l_orderkey)"""

# ----- chats, from conversations -----------------------------------------------------------------


def exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the turn that answers them, where there is one."""
    c = table(spark, sf, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return user.join(reply, ["conv_id", "turn"], "left")


EXCHANGES = """exchanges AS (
 SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
 FROM conversations u LEFT JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""

# ----- answers that asked for a tool, from documents -----------------------------------------------


def tool_answers(spark: SparkSession, sf: str) -> DataFrame:
    ends = F.when(F.col("n_chars") % 2 == 0, F.lit(TOOL_STOP_SENTENCE)).otherwise(F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.concat("text", ends).alias("answer"))


TOOL_ANSWERS = f"""tool_answers AS (
 SELECT doc_id, concat(text, CASE WHEN n_chars % 2 = 0 THEN '{TOOL_STOP_SENTENCE}' ELSE '' END) AS answer FROM documents)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
