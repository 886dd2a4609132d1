"""Extraction, comparison and text predicates over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollmill.catalog.registry import query, r6
from rollmill.catalog.views import (
    CODE_TASKS, GRADED, MATH_ANSWERS, ROLLOUT_ID, ROLLOUTS, TOOL_ANSWERS,
    code_tasks, graded, math_answers, rollouts, table, tool_answers, with_views,
)
from rollmill.functions import text as T

_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NWS = _WS.replace("[", "[^", 1)
_ID = ", ".join(["q_id", *ROLLOUT_ID])


def _strip(sql: str) -> str:
    return rf"regexp_replace(regexp_replace({sql}, '^{_WS}+', ''), '{_WS}+$', '')"


@query(with_views(GRADED) + f"SELECT doc_id, {_strip('''string_split(answer_raw, '####')[-1]''')} AS gold FROM graded")
def gold_answer(spark, sf):
    return graded(spark, sf).select("doc_id", T.gold_answer("answer_raw").alias("gold"))


@query(r"SELECT doc_id, regexp_extract_all(text, '\d+\.\d+|\d+/\d+|\d+')[-1] AS number FROM documents")
def last_number(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.last_number("text").alias("number"))


@query(r"SELECT doc_id, regexp_extract_all(text, '-?\d+\.\d+|-?\d+/\d+|-?\d+')[-1] AS number FROM documents")
def last_number_signed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.last_number_signed("text").alias("number"))


def _fmt(sep: str) -> str:
    return rf"regexp_matches(answer, '(?s)^<think>.*?</think>{sep}<answer>.*?</answer>\n?$')"


_BOTH = """all_answers AS (SELECT 'rollout' AS kind, q_id AS id, line, partkey, answer FROM rollouts
 UNION ALL SELECT 'document', doc_id, 0, 0, text FROM documents)"""


def _all_answers(spark, sf):
    made = rollouts(spark, sf).select(F.lit("rollout").alias("kind"), F.col("q_id").alias("id"), "line", "partkey", "answer")
    docs = table(spark, sf, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).alias("line"),
        F.lit(0).cast("bigint").alias("partkey"), F.col("text").alias("answer"),
    )
    return made.unionByName(docs)


@query(with_views(ROLLOUTS, _BOTH) + rf"""SELECT kind, id, line, partkey, {_fmt('[\n ]*')} AS loose,
 {_fmt('[\n ]')} AS one, {_fmt('')} AS tight FROM all_answers""")
def think_format(spark, sf):
    return _all_answers(spark, sf).select(
        "kind", "id", "line", "partkey",
        T.think_format("answer", T.SEP_LOOSE).alias("loose"),
        T.think_format("answer", T.SEP_ONE).alias("one"),
        T.think_format("answer", T.SEP_NONE).alias("tight"),
    )


@query(with_views(ROLLOUTS, _BOTH) + rf"""SELECT kind, id, line, partkey,
 len(regexp_extract_all(answer, '</?think>')) = 2 AND len(regexp_extract_all(answer, '</?answer>')) = 2 AS counts_ok,
 {_fmt('[\n ]*')} AND len(regexp_extract_all(answer, '</?think>')) = 2
  AND len(regexp_extract_all(answer, '</?answer>')) = 2 AS strict FROM all_answers""")
def tag_counts_ok(spark, sf):
    return _all_answers(spark, sf).select(
        "kind", "id", "line", "partkey", T.tag_counts_ok("answer").alias("counts_ok"),
        T.think_format_strict("answer").alias("strict"),
    )


_BOXED = r"regexp_extract_all({x}, '\\boxed\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}', 1)[-1]"
_DOLLAR = r"regexp_extract_all({x}, '(?s)\$(.+?)\$', 1)[-1]"


def _boxed(x: str) -> str:
    return _BOXED.format(x=x)


def _cascade(x: str) -> str:
    return f"coalesce({_strip(_boxed(x))}, {_strip(_DOLLAR.format(x=x))})"


_TAG = _strip("regexp_extract_all(answer, '(?s)<answer>(.*?)</answer>', 1)[1]")
_EXTRACTED = rf"""extracted AS (SELECT *, coalesce(nullif({_cascade('body')}, ''), body) AS tag,
 {_cascade('answer')} AS loose, regexp_extract_all(answer, '-?\d+\.\d+|-?\d+/\d+|-?\d+')[-1] AS number
 FROM (SELECT *, {_TAG} AS body FROM math_answers))"""


@query(with_views(MATH_ANSWERS) + f"SELECT {_ID}, {_boxed('answer')} AS boxed FROM math_answers")
def boxed_nested(spark, sf):
    return math_answers(spark, sf).select("q_id", *ROLLOUT_ID, T.boxed_nested("answer").alias("boxed"))


_ODD = "replace(replace(replace(answer, '1', chr(64976)), '2', chr(64977)), '3', chr(64978))"  # noncharacters


@query(with_views(MATH_ANSWERS) + f"SELECT {_ID}, {_boxed(_ODD)} AS boxed FROM math_answers")
def boxed_nested_odd(spark, sf):
    odd = F.translate("answer", "123", "\ufdd0\ufdd1\ufdd2")
    return math_answers(spark, sf).select("q_id", *ROLLOUT_ID, T.boxed_nested(odd).alias("boxed"))


@query(with_views(MATH_ANSWERS) + f"SELECT {_ID}, {_strip(_DOLLAR.format(x='answer'))} AS math FROM math_answers")
def dollar_math(spark, sf):
    return math_answers(spark, sf).select("q_id", *ROLLOUT_ID, T.dollar_math("answer").alias("math"))


@query(with_views(MATH_ANSWERS, _EXTRACTED) + f"SELECT {_ID}, tag FROM extracted")
def answer_tag(spark, sf):
    return math_answers(spark, sf).select("q_id", *ROLLOUT_ID, T.answer_tag("answer").alias("tag"))


@query(with_views(MATH_ANSWERS, _EXTRACTED) + f"SELECT {_ID}, coalesce(tag, loose, number) AS extracted FROM extracted")
def extract_math_answer(spark, sf):
    return math_answers(spark, sf).select("q_id", *ROLLOUT_ID, T.extract_math_answer("answer").alias("extracted"))


def _normal(x: str) -> str:
    y = rf"replace(replace(replace({_strip(x)}, '$', ''), '\,', ''), '\!', '')"
    y = rf"regexp_replace({y}, '\\left{_WS}*([()])', '\1', 'g')"
    y = rf"regexp_replace({y}, '\\right{_WS}*([()])', '\1', 'g')"
    y = rf"regexp_replace({y}, '\\text\{{(.+?)\}}', '\1', 'g')"
    part = rf"\{{{_WS}*([^{{}}]+?){_WS}*\}}"
    y = rf"regexp_replace({y}, '\\frac{_WS}*{part}{_WS}*{part}', '(\1)/(\2)', 'g')"
    return f"replace({y}, ' ', '')"


@query(with_views(MATH_ANSWERS) + f"SELECT {_ID}, {_normal('answer')} AS normal, {_normal('gold')} AS normal_gold FROM math_answers")
def normalize_latex(spark, sf):
    return math_answers(spark, sf).select(
        "q_id", *ROLLOUT_ID, T.normalize_latex("answer").alias("normal"), T.normalize_latex("gold").alias("normal_gold")
    )


def _spread(spark, sf):
    """The keys of all order lines, dealt evenly: a file with few row groups would keep few cores busy."""
    keys = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return keys.repartition(4 * spark.sparkContext.defaultParallelism)


@query("""SELECT l_orderkey AS q_id, l_linenumber AS line, l_partkey AS partkey, l_suppkey AS suppkey,
 (l_partkey % 12) * 2 = l_linenumber * (l_suppkey % 5 + 1) AS half_equal,
 l_partkey % 7 = l_suppkey % 7 AS sign_equal,
 l_partkey % 9 = l_linenumber AS thousand_equal, false AS word_equal FROM lineitem""")
def math_equal(spark, sf):
    li = _spread(spark, sf)
    fraction = F.expr("concat(l_partkey % 12, '/', l_suppkey % 5 + 1)")
    decimal = F.expr("concat(l_linenumber div 2, CASE WHEN l_linenumber % 2 = 1 THEN '.50' ELSE '.0' END)")
    minus = F.expr("concat('-', l_partkey % 7 + 1)")
    minus_frac = F.expr("concat('-(', (l_suppkey % 7 + 1) * 3, ')/(3)')")
    thousand = F.expr("concat(l_partkey % 9 + 1, ',000')")
    plain = F.expr("concat('0', l_linenumber + 1, '000.00')")
    return li.select(
        F.col("l_orderkey").alias("q_id"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"),
        T.math_equal(fraction, decimal).alias("half_equal"),
        T.math_equal(minus, minus_frac).alias("sign_equal"),
        T.math_equal(thousand, plain).alias("thousand_equal"),
        T.math_equal(fraction, F.concat(F.lit("x"), fraction)).alias("word_equal"),
    )


@query("""SELECT l_orderkey AS q_id, l_linenumber AS line, l_partkey AS partkey, l_suppkey AS suppkey,
 repeat(CAST(l_partkey % 9 + 1 AS VARCHAR), 41) = repeat(CAST(l_suppkey % 9 + 1 AS VARCHAR), 41) AS whole_equal,
 repeat(CAST(l_partkey % 9 + 1 AS VARCHAR), 80) = repeat(CAST(l_partkey % 9 + 1 AS VARCHAR), 79 + l_linenumber % 2) AS length_equal,
 l_partkey % 5 + 1 = l_suppkey % 5 + 1 AS fraction_equal FROM lineitem""")
def math_equal_long(spark, sf):
    li = _spread(spark, sf)
    one, other = F.expr("repeat(l_partkey % 9 + 1, 41)"), F.expr("concat('00', repeat(l_suppkey % 9 + 1, 41), '.', repeat('0', l_linenumber))")
    eighty, near = F.expr("repeat(l_partkey % 9 + 1, 80)"), F.expr("concat(repeat(l_partkey % 9 + 1, 79 + l_linenumber % 2), '.0')")
    thirty, small = F.expr("concat(repeat(l_partkey % 5 + 1, 30), '/', repeat('7', 30))"), F.expr("concat(l_suppkey % 5 + 1, '/7')")
    return li.select(
        F.col("l_orderkey").alias("q_id"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"),
        T.math_equal(one, other).alias("whole_equal"),
        T.math_equal(eighty, near).alias("length_equal"),
        T.math_equal(thirty, small).alias("fraction_equal"),
    )


_MATH_CORRECT = with_views(MATH_ANSWERS) + f"""SELECT {_ID}, CASE line % 6
  WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN partkey % 5 = partkey % 7 WHEN 3 THEN partkey % 5 = partkey % 7
  WHEN 4 THEN suppkey % 7 = partkey % 7 ELSE true END AS correct FROM math_answers"""


@query(_MATH_CORRECT)
def math_correct(spark, sf):
    return math_answers(spark, sf).select("q_id", *ROLLOUT_ID, T.math_correct("answer", "gold").alias("correct"))


@query(_MATH_CORRECT)
def with_math_correct(spark, sf):
    return T.with_math_correct(math_answers(spark, sf)).select("q_id", *ROLLOUT_ID, "correct")


@query(with_views(ROLLOUTS) + f"SELECT {_ID}, correct FROM rollouts")
def numeric_correct(spark, sf):
    return rollouts(spark, sf).select("q_id", *ROLLOUT_ID, T.numeric_correct("answer", "gold").alias("correct"))


@query(with_views(MATH_ANSWERS) + f"""SELECT {_ID}, coalesce({_boxed('answer')} IS NOT NULL
  AND (line % 6 = 0 OR (line % 6 = 2 AND partkey % 5 = partkey % 7)), false) AS equal FROM math_answers""")
def boxed_equal(spark, sf):
    gold = F.concat(F.lit("The result is \\boxed{"), F.btrim("gold"), F.lit("}"))
    return math_answers(spark, sf).select("q_id", *ROLLOUT_ID, T.boxed_equal("answer", gold).alias("equal"))


_CODE = r"regexp_extract_all(answer, '(?s)```python\n(.*?)\n```', 1)[1]"


@query(with_views(CODE_TASKS) + f"""SELECT idx, coalesce({_strip(_CODE)}, answer) AS code,
 CASE WHEN {_CODE} IS NULL THEN -1 ELSE 1 END AS flag FROM code_tasks""")
def python_block(spark, sf):
    return code_tasks(spark, sf).select(
        "idx", T.python_block("answer").alias("code"), T.python_block_flag("answer").alias("flag")
    )


@query(with_views(CODE_TASKS) + f"""SELECT idx, CASE WHEN s > 0 AND strpos(rest, '```') > 0
  THEN {_strip("substr(rest, 1, strpos(rest, '```') - 1)")} ELSE 'Error! Python code block not found.' END AS code
 FROM (SELECT idx, strpos(answer, '```python') AS s, substr(answer, strpos(answer, '```python') + 9) AS rest FROM code_tasks)""")
def python_block_loose(spark, sf):
    return code_tasks(spark, sf).select("idx", T.python_block_loose("answer").alias("code"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_NWS}+')) AS INT) AS words FROM documents")
def word_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_count("text").alias("words"))


@query(with_views(CODE_TASKS) + """SELECT idx, n_code, n_error, round((n_code - n_error) * 0.1, 6) AS score FROM (
  SELECT idx, CAST((length(answer) - length(replace(answer, '```python', ''))) // 9 AS INT) AS n_code,
   CAST((length(answer) - length(replace(answer, 'Error!', ''))) // 6 AS INT) AS n_error FROM code_tasks)""".replace("* 0.1", "* 0.1::DOUBLE"))
def tool_score(spark, sf):
    return code_tasks(spark, sf).select(
        "idx", T.count_substring("answer", T.CODE_FENCE).alias("n_code"),
        T.count_substring("answer", T.TOOL_ERROR).alias("n_error"), r6(T.tool_score("answer")).alias("score"),
    )


@query(with_views(ROLLOUTS) + f"SELECT {_ID}, answer AS cleaned FROM rollouts")
def strip_special(spark, sf):
    marked = F.concat(F.lit("<|im_end|>"), "answer", F.lit("<|endoftext|><|im_end|><|endoftext|>"))
    return rollouts(spark, sf).select("q_id", *ROLLOUT_ID, T.strip_special(marked).alias("cleaned"))


@query(with_views(TOOL_ANSWERS) + f"SELECT doc_id, ends_with(answer, '{T.TOOL_STOP_SENTENCE}') AS wants_tool FROM tool_answers")
def requested_tool(spark, sf):
    return tool_answers(spark, sf).select("doc_id", T.requested_tool("answer").alias("wants_tool"))


@query(with_views(ROLLOUTS) + f"""SELECT {_ID}, reward = 2.25 AS full_reward, printf('%.2f', reward) AS bin,
 round(reward / 3, 4) AS third FROM rollouts""")
def is_close(spark, sf):
    near = F.col("reward") + F.lit(1e-6)
    return rollouts(spark, sf).select(
        "q_id", *ROLLOUT_ID, T.is_close(near, F.lit(2.25)).alias("full_reward"),
        T.two_decimals("reward").alias("bin"), F.round(F.col("reward") / 3, 4).alias("third"),
    )
