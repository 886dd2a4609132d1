import re

import pytest
from pyspark.sql import functions as F

from rollmill.functions import text as T


def value(spark, make, *inputs):
    """Evaluate an expression over literal columns a, b, ... that the optimizer cannot fold."""
    names = [chr(ord("a") + i) for i in range(len(inputs))]
    df = spark.createDataFrame([inputs], ", ".join(f"{n} string" for n in names))
    return df.select(make(*names).alias("v")).first()["v"]


GOLDEN = [
    (T.gold_answer, "a #### b ####  42 \n", "42"),
    (T.gold_answer, "42", "42"),
    (T.gold_answer, "a#####b", "#b"),
    (T.last_number, "x 1.50 y 3/4", "3/4"),
    (T.last_number, "1,000", "000"),
    (T.last_number, "-7", "7"),
    (T.last_number, "none", None),
    (T.last_number, "1.5/2", "2"),
    (T.last_number, "12.", "12"),
    (T.last_number_signed, "is -7", "-7"),
    (T.think_format, "<think>a\nb</think>\n <answer>3</answer>", True),
    (lambda c: T.think_format(c, T.SEP_ONE), "<think>a</think><answer>3</answer>", False),
    (lambda c: T.think_format(c, T.SEP_NONE), "<think>a</think> <answer>3</answer>", False),
    (T.think_format, "<think>a</think><answer>3</answer>\n", True),
    (T.think_format, "<think>a</think><answer>3</answer> ", False),
    (T.think_format, "<think>a</think><answer>3</answer>\r", False),
    (T.think_format, "<think>a<think></think><answer>b</answer>", True),
    (T.think_format_strict, "<think>a<think></think><answer>b</answer>", False),
    (T.boxed_nested, r"\boxed{1} \boxed{\frac{1}{2}}", r"\frac{1}{2}"),
    (T.boxed_nested, r"\boxed{a{b{c}}}", None),
    (T.boxed_nested, r"\boxed{x \boxed{1} y}", r"x \boxed{1} y"),
    (T.boxed_nested, r"\boxed{}", ""),
    (T.boxed_nested, r"\boxed{a{b}", None),
    (T.boxed_nested, "\\boxed{a\nb}", "a\nb"),
    (T.boxed_nested, "nothing {a}", None),
    (T.dollar_math, "it is $ a\nb $ so", "a\nb"),
    (T.answer_tag, "<answer> </answer> \\boxed{3}", ""),
    (T.answer_tag, "x", None),
    (T.answer_tag, "<answer>so $4$</answer><answer>5</answer>", "4"),
    (T.extract_math_answer, "no tag \\boxed{ 5 } and $6$", "5"),
    (T.extract_math_answer, "it is -3/4", "-3/4"),
    (T.extract_math_answer, "word", None),
    (T.normalize_latex, r"$\left( \frac{1}{2} \right) \text{cm}$", "((1)/(2))cm"),
    (T.normalize_latex, "\u2003 7 \x1c", "7"),
    (T.python_block, "no fence", "no fence"),
    (T.python_block_flag, "no fence", -1),
    (T.python_block, "a ```python\nx = 1\n\n``` b", "x = 1"),
    (T.python_block_loose, "a ```python y ``` b", "y"),
    (T.python_block_loose, "a ```python y", T.NO_CODE_TEXT),
    (T.word_count, "a  b\u00a0c", 3),
    (T.word_count, " ", 0),
    (T.tool_score, "```python x ```python Error!", pytest.approx(0.1)),
    (T.strip_special, "a<|im_end|><|endoftext|>", "a"),
    (T.requested_tool, "x The result of executing this Python code is:", True),
    (T.insert_after_thought, "a</think>b</think>", "a</think><think></think>b</think>"),
    (T.insert_after_thought, "plain", "plain"),
]


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(spark, i):
    make, given, expected = GOLDEN[i]
    assert value(spark, make, given) == expected


EQUAL = [
    ("0.5", "1/2", True),
    ("7", "-7", False),
    ("1,000", "1000.0", True),
    ("007", "7", True),
    ("(1)/(2)", "0.50", True),
    ("-(3)/(6)", "-0.5", True),
    ("(-1)/(2)", "-0.5", True),
    ("1/3", "0.333333", False),
    ("12345678901234567890.5", "24691357802469135781/2", True),
    ("12345678901234567890.5", "24691357802469135782/2", False),
    ("0.1234567890123", "0.12345678901230", True),
    ("1/0", "2/0", False),
    ("1/0", "1/0", True),
    (" x ", "x", True),
    ("x", "y", False),
    ("9" * 60, "9" * 60 + ".0", True),
    ("1" + "0" * 25, "1" + "0" * 25 + "." + "0" * 15, True),
    ("7" * 41, "7" * 41 + ".0", True),
    ("7" * 41, "-" + "7" * 41, False),
    ("3" * 80, "0" + "3" * 80 + ".00", True),
    ("3" * 80, "3" * 79 + "4", False),
    ("1" * 30 + "/" + "7" * 30, "1/7", True),
    ("1" * 30 + "/" + "7" * 29 + "8", "1/7", False),
    ("2" * 90 + "/" + "6" * 90, "-(" + "1" * 45 + ")/(-" + "3" * 45 + ")", True),
    ("0." + "0" * 50, "-0/" + "5" * 40, True),
    ("5" * 40 + "/" + "0" * 12, "5" * 41 + "/0", False),
    ("1.2.3", "1.2", False),
    ("", "", True),
    ("", "0", False),
]


@pytest.mark.parametrize("a,b,expected", EQUAL)
def test_math_equal(spark, a, b, expected):
    assert value(spark, T.math_equal, a, b) is expected
    assert value(spark, T.math_equal, b, a) is expected


def test_math_equal_is_exact(spark):
    from fractions import Fraction
    from random import Random

    r = Random(3)

    def number(n: int) -> str:
        digits = "".join(r.choice("0019") for _ in range(n))
        at = r.randrange(1, n + 1)
        return digits[:at] + "." * (at < n) + digits[at:]

    rows = []
    for _ in range(400):
        a, b = number(r.randrange(1, 30)), number(r.randrange(1, 30))
        m = number(r.randrange(1, 12))
        x, y = Fraction(a), Fraction(b) or Fraction(1)
        z = Fraction(m) or Fraction(1)
        pair = (x / y * z).as_integer_ratio()
        rows.append((f"{pair[0]}/{pair[1]}", f"{pair[0] * 10**12 + r.choice([0, 0, 1])}/{pair[1] * 10**12}"))
        rows.append((a, b + "0" * 12))
    found = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.math_equal("a", "b").alias("same")).collect()
    assert [f.same for f in found] == [Fraction(f.a) == Fraction(f.b) for f in found]
    assert any(f.same for f in found) and not all(f.same for f in found)


def test_math_equal_null(spark):
    assert value(spark, T.math_equal, None, "1") is None
    assert value(spark, T.numeric_correct, "no number", "1") is False


def test_boxed_equal(spark):
    assert value(spark, T.boxed_equal, r"so \boxed{1/2}", r"\boxed{0.5}") is True
    assert value(spark, T.boxed_equal, r"so \boxed{x+1}", r"\boxed{x+1}") is True
    assert value(spark, T.boxed_equal, "so 1", r"\boxed{1}") is False
    assert value(spark, T.boxed_equal, r"\boxed{1}", "1") is False


def test_staged_grading_agrees(spark):
    rows = [("<answer>\\boxed{ \\frac{1}{2} }</answer>", "0.5"), ("so -4", "-4"), ("none", "x"), (None, "1"),
            ("<answer></answer>", "1"), ("$x$", " x ")]
    df = spark.createDataFrame(rows, "answer string, gold string")
    both = T.with_math_correct(df.withColumn("direct", T.math_correct("answer", "gold"))).collect()
    assert [r["correct"] for r in both] == [True, True, False, False, False, True]
    assert [r["direct"] for r in both] == [r["correct"] for r in both]


def test_long_texts_do_not_overflow_the_stack(spark):
    filler = "{a}" * 50_000
    assert value(spark, T.boxed_nested, "\\boxed{" + filler + "}") == filler
    assert value(spark, T.boxed_nested, "\\boxed{" + filler) is None
    long = "<think>" + "a\n" * 100_000 + "</think><answer>" + "b " * 100_000 + "</answer>"
    assert value(spark, T.think_format_strict, long) is True
    assert value(spark, T.word_count, long) == len(long.split())


def test_boxed_agrees_with_a_plain_pattern(spark):
    pattern = re.compile(r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}")
    pieces = ["\\boxed{", "{", "}", "a", "\\boxed", "\n", "{b}"]
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    mine = [r["v"] for r in df.select(T.boxed_nested("a").alias("v")).collect()]
    assert mine == [(pattern.findall(t) or [None])[-1] for t in texts]


def test_whitespace_set_is_that_of_isspace(spark):
    every = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())
    assert set(T.PY_WHITESPACE) == set(every)
    df = spark.createDataFrame([(f"a{c}b", f"{c}a{c}") for c in every], "a string, b string")
    rows = df.select(T.word_count("a").alias("n"), T.strip("b").alias("s")).collect()
    assert all((r.n, r.s) == (2, "a") for r in rows)


def test_close_and_formats(spark):
    df = spark.createDataFrame([(2.25 + 1e-6,), (2.2,)], "x double")
    rows = df.select(T.is_close("x", F.lit(2.25)).alias("c"), T.two_decimals("x").alias("t")).collect()
    assert [(r.c, r.t) for r in rows] == [(True, "2.25"), (False, "2.20")]


def test_boxes_with_noncharacters(spark):
    """The characters that stand for braces inside the library may occur in the text itself."""
    a, b, c = "\ufdd0", "\ufdd1", "\ufdd2"
    rows = [(f"\\boxed{{x{a}y}}", f"x{a}y"), (f"\\boxed{{{b}{{z{a}}}w{c}0}}", f"{b}{{z{a}}}w{c}0"), (f"{a}{b} \\boxed{{{c}1{c}{c}2}}", f"{c}1{c}{c}2"), (f"\\boxed{a}q{b}", None)]
    got = spark.createDataFrame(rows, "answer string, want string").select(T.boxed_nested("answer").alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_math_equal_is_null_for_nulls_only(spark):
    assert value(spark, T.math_equal, "5\u0085", "5") is True


def test_lines_are_dealt_over_all_cores(spark, sf):
    from rollmill.catalog.text_queries import _spread

    counts = _spread(spark, sf).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(counts) >= spark.sparkContext.defaultParallelism
