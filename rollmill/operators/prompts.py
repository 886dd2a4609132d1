"""Prompt construction: question views, chat rendering, variants and test programs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions.text import ColumnOrName, _col, strip

# --- fixed values: prompt and program texts ----------------------------------------------------
TRAIN_SETUP = ("Set up code is given: <setup_code>", "</setup_code>. ")
EVAL_SETUP = (" Set up code is given: <setup_code>", "</setup_code>. ")
CODE_FORMAT = "\n Code Format: "
TESTS_GIVEN = "\n Three tests are given: "
RETRY_TEXT = (
    "Your previous answer was incorrect. Check the previous steps. If you know where you went wrong, "
    "solve it correctly. Otherwise, try a different approach to solve the problem."
)
ASSERT_PROGRAM = (
    "\ntry:\n    ",
    "\n    print('TEST_PASSED')\nexcept Exception as e:\n    print(f'TEST_FAILED: {e}')",
)
STUB_PROGRAM = "\nresult = None\nprint('TEST_RESULT:', result)"
# -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ChatTemplate:
    """How a chat turns into text: `{role}` in the prefix is the speaker."""

    prefix: str = "<|im_start|>{role}\n"
    suffix: str = "<|im_end|>\n"
    reply: str = "<|im_start|>assistant\n"


def as_qa(df: DataFrame, q: str, a: str) -> DataFrame:
    return df.select(F.col(q).alias("Q"), F.col(a).alias("A"))


def message(role: str, content: ColumnOrName) -> Column:
    return F.struct(F.lit(role).alias("role"), _col(content).alias("content"))


def chat(system: ColumnOrName, user: ColumnOrName) -> Column:
    return F.array(message("system", system), message("user", user))


def retry_chat(system: ColumnOrName, user: ColumnOrName, first_answer: ColumnOrName) -> Column:
    """The chat that shows a wrong first answer and asks for another try."""
    return F.array(
        message("system", system),
        message("user", user),
        message("assistant", first_answer),
        message("user", F.lit(RETRY_TEXT)),
    )


def render_chat(messages: ColumnOrName, template: ChatTemplate = ChatTemplate()) -> Column:
    """Text of a message list, open for the assistant's reply."""
    def render(m: Column) -> Column:
        prefix = F.replace(F.lit(template.prefix), F.lit("{role}"), m["role"])
        return F.concat(prefix, m["content"], F.lit(template.suffix))

    return F.concat(F.array_join(F.transform(_col(messages), render), ""), F.lit(template.reply))


def render_retry(
    df: DataFrame, system: str, question: str = "question", answer: str = "answer",
    template: ChatTemplate = ChatTemplate(),
) -> DataFrame:
    return df.withColumn("prompt", render_chat(retry_chat(F.lit(system), question, answer), template))


def code_train_prompt(df: DataFrame, text: str = "text", setup: str = "test_setup_code", tests: str = "test_list") -> DataFrame:
    """Task text, setup code if any, and the call expected by the first test."""
    first = F.get(_col(tests), F.lit(0))
    call = F.get(F.split(F.get(F.split(first, "assert "), F.lit(1)), "=="), F.lit(0))
    given = _setup_text(setup, TRAIN_SETUP)
    return df.withColumn("prompt", F.concat(F.col(text), given, F.lit(CODE_FORMAT), call))


def code_eval_prompt(df: DataFrame, text: str = "text", setup: str = "setup_code", tests: str = "test_list") -> DataFrame:
    """Task text, setup code if any, and the tests as a Python list display."""
    given = _setup_text(setup, EVAL_SETUP)
    return df.withColumn("prompt", F.concat(F.col(text), given, F.lit(TESTS_GIVEN), python_list(tests)))


def _setup_text(setup: str, around: tuple[str, str]) -> Column:
    code = F.coalesce(F.col(setup), F.lit(""))
    return F.when(code == "", F.lit("")).otherwise(F.concat(F.lit(around[0]), code, F.lit(around[1])))


def python_list(items: ColumnOrName) -> Column:
    """An array of strings as Python prints a list: single quotes unless only those occur inside.

    Backslash, newline, return and tab are escaped; other unprintable characters are kept.
    """
    def quoted(s: Column) -> Column:
        body = F.replace(s, F.lit("\\"), F.lit("\\\\"))
        for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            body = F.replace(body, F.lit(raw), F.lit(shown))
        double = F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"'))
        single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single)

    return F.concat(F.lit("["), F.array_join(F.transform(_col(items), quoted), ", "), F.lit("]"))


def expand_prompt_variants(df: DataFrame, variants: Mapping[str, str], n: int) -> DataFrame:
    """`n` prompts per question, the variants taking turns; each row has its variant and system text.

    The variants are literals of the plan, so each question expands where it is.
    """
    turns = F.array(*[F.struct(F.lit(k).alias("variant"), F.lit(v).alias("system")) for k, v in variants.items()])
    copies = n // len(variants)
    slots = F.flatten(F.array_repeat(turns, copies))
    return df.select("*", F.posexplode(slots).alias("slot", "_turn")).select("*", "_turn.*").drop("_turn")


def expand_tests(df: DataFrame, tests: str = "test_list") -> DataFrame:
    """One row per code answer and test."""
    return df.select("*", F.posexplode(tests).alias("test_case", "test")).drop(tests)


def build_test_programs(
    df: DataFrame, code: str = "code", tests: str = "test_list", setup: str | None = "test_setup_code"
) -> DataFrame:
    """The program text that would check each test; a test without an assert can never pass."""
    rows = expand_tests(df, tests)
    body = F.col(code)
    if setup:
        given = F.coalesce(F.col(setup), F.lit(""))
        body = F.when(strip(given) != "", F.concat(given, F.lit("\n"), body)).otherwise(body)
    check = F.concat(F.lit(ASSERT_PROGRAM[0]), F.col("test"), F.lit(ASSERT_PROGRAM[1]))
    checked = F.when(F.contains(F.col("test"), F.lit("assert")), check).otherwise(F.lit(STUB_PROGRAM))
    return rows.withColumn("program", F.concat(body, F.lit("\n\n"), checked))
