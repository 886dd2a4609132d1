"""Prompt construction and question joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.catalog.registry import query
from rollmill.catalog.views import (
    CODE_TASKS, EXCHANGES, GRADED, QUESTIONS, ROLLOUT_ID, ROLLOUTS,
    code_tasks, exchanges, graded, questions, rollouts, with_views,
)
from rollmill.functions.text import python_block
from rollmill.operators import joins as J
from rollmill.operators import prompts as P

SYSTEM = "You solve problems."
_SYS = f"'<|im_start|>system' || chr(10) || '{SYSTEM}<|im_end|>' || chr(10)"


def _turn(role: str, text: str) -> str:
    return f"'<|im_start|>{role}' || chr(10) || {text} || '<|im_end|>' || chr(10)"


_OPEN = "'<|im_start|>assistant' || chr(10)"


@query(with_views(GRADED) + """SELECT md5(answer) AS question_md5, CAST(doc_id AS VARCHAR) AS "A" FROM graded""")
def as_qa(spark, sf):
    done = P.as_qa(graded(spark, sf).select("answer", F.col("doc_id").cast("string").alias("gold")), "answer", "gold")
    return done.select(F.md5(F.col("Q").cast("binary")).alias("question_md5"), "A")


@query(with_views(EXCHANGES) + f"SELECT conv_id, turn, {_SYS} || {_turn('user', 'question')} || {_OPEN} AS prompt FROM exchanges")
def render_chat(spark, sf):
    return exchanges(spark, sf).select(
        "conv_id", "turn", P.render_chat(P.chat(F.lit(SYSTEM), "question")).alias("prompt")
    )


@query(with_views(EXCHANGES) + f"""SELECT conv_id, turn, {_SYS} || {_turn('user', 'question')} || {_turn('assistant', 'answer')}
 || {_turn('user', "'" + P.RETRY_TEXT + "'")} || {_OPEN} AS prompt FROM exchanges WHERE answer IS NOT NULL""")
def render_retry(spark, sf):
    rows = exchanges(spark, sf).where("answer IS NOT NULL")
    return P.render_retry(rows, SYSTEM).select("conv_id", "turn", "prompt")


@query(with_views(CODE_TASKS) + """SELECT idx, text || CASE WHEN test_setup_code = '' THEN '' ELSE 'Set up code is given: <setup_code>' || test_setup_code || '</setup_code>. ' END
 || chr(10) || ' Code Format: ' || string_split(string_split(test_list[1], 'assert ')[2], '==')[1] AS prompt FROM code_tasks""")
def code_train_prompt(spark, sf):
    return P.code_train_prompt(code_tasks(spark, sf)).select("idx", "prompt")


@query(with_views(CODE_TASKS) + """SELECT idx, text || CASE WHEN test_setup_code = '' THEN '' ELSE ' Set up code is given: <setup_code>' || test_setup_code || '</setup_code>. ' END
 || chr(10) || ' Three tests are given: [' || '''' || test_list[1] || ''', ''' || replace(test_list[2], '''', '\\''') || ''', "' || test_list[3] || '"]' AS prompt FROM code_tasks""".replace("'\\\\'''", "'\\'''"))
def code_eval_prompt(spark, sf):
    return P.code_eval_prompt(code_tasks(spark, sf), setup="test_setup_code").select("idx", "prompt")


@query(with_views(EXCHANGES) + """SELECT conv_id, turn, slot::INT AS slot, CASE WHEN slot % 2 = 0 THEN 'zero' ELSE 'one' END AS variant,
 CASE WHEN slot % 2 = 0 THEN 'Solve it.' ELSE 'Solve it like the example.' END AS system FROM exchanges, range(8) s(slot)""")
def expand_prompt_variants(spark, sf):
    variants = {"zero": "Solve it.", "one": "Solve it like the example."}
    rows = exchanges(spark, sf).select("conv_id", "turn")
    return P.expand_prompt_variants(rows, variants, 8)


@query(with_views(CODE_TASKS) + "SELECT idx, (i - 1)::INT AS test_case, test_list[i] AS test FROM code_tasks, LATERAL (SELECT unnest(range(1, 4)) AS i)")
def expand_tests(spark, sf):
    return P.expand_tests(code_tasks(spark, sf).select("idx", "test_list"))


_CODE = "coalesce(trim(regexp_extract_all(answer, '(?s)```python\\n(.*?)\\n```', 1)[1], chr(10) || ' '), answer)"
_PRE = "CASE WHEN test_setup_code <> '' THEN test_setup_code || chr(10) ELSE '' END"


@query(with_views(CODE_TASKS) + f"""SELECT idx, (i - 1)::INT AS test_case, {_PRE} || {_CODE} || chr(10) || chr(10) || CASE WHEN contains(test_list[i], 'assert')
  THEN chr(10) || 'try:' || chr(10) || '    ' || test_list[i] || chr(10) || '    print(''TEST_PASSED'')' || chr(10) || 'except Exception as e:' || chr(10)
   || '    print(f''TEST_FAILED: {{e}}'')'
  ELSE chr(10) || 'result = None' || chr(10) || 'print(''TEST_RESULT:'', result)' END AS program
 FROM code_tasks, LATERAL (SELECT unnest(range(1, 4)) AS i)""")
def build_test_programs(spark, sf):
    rows = code_tasks(spark, sf).withColumn("code", python_block("answer"))
    return P.build_test_programs(rows).select("idx", "test_case", "program")


@query(with_views(ROLLOUTS, QUESTIONS) + "SELECT q_id, line, partkey, suppkey, question, r.gold FROM rollouts r JOIN questions USING (q_id)")
def attach_questions(spark, sf):
    rows = rollouts(spark, sf).select("q_id", *ROLLOUT_ID)
    return J.attach_questions(rows, questions(spark, sf))
