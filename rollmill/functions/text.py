"""Answer extraction, answer comparison and text predicates.

Patterns are written so that java.util.regex never recurses per repetition: a group repeated
many thousand times overflows the executor stack and takes the JVM with it, and answers are
processed whole, however long they are.
"""

from __future__ import annotations

import decimal
import re
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str

# --- fixed values: markers and patterns that define the results -------------------------------
GOLD_MARK = "####"
UNSIGNED_NUMBER = r"\d+(?:\.\d+|/\d+)?"  # decimal, simple fraction or integer
SIGNED_NUMBER = r"-?\d+(?:\.\d+|/\d+)?"
SEP_LOOSE = r"[\n ]*"
SEP_ONE = r"[\n ]"
SEP_NONE = ""
SPECIAL_TOKENS = ("<|im_end|>", "<|endoftext|>")
THINK_CLOSE = "</think>"
EMPTY_THINK = "<think></think>"
CODE_FENCE = "```python"
FENCE = "```"
TOOL_ERROR = "Error!"
NO_CODE_TEXT = "Error! Python code block not found."
TOOL_STOP_SENTENCE = "The result of executing this Python code is:"
# characters for which str.isspace() holds
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# ---------------------------------------------------------------------------------------------

_WS = r"[\s\x1c-\x1f]"  # with (?U): the same set as PY_WHITESPACE
# They stand for braces of leaf pairs; where a text holds one itself, it is written as _ESCAPE and a digit.
_OPEN, _CLOSE, _ESCAPE = "\ufdd0", "\ufdd1", "\ufdd2"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _last(hits: Column) -> Column:
    return F.try_element_at(hits, F.lit(-1))


def strip(c: ColumnOrName) -> Column:
    """Trim every Unicode whitespace character, not only blanks."""
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def gold_answer(c: ColumnOrName) -> Column:
    """Text after the last `####`, stripped; the whole text where there is none."""
    return strip(F.element_at(F.split(_col(c), GOLD_MARK, -1), -1))


def last_number(c: ColumnOrName) -> Column:
    """Last unsigned decimal, simple fraction or integer; NULL when there is none."""
    return _last(F.regexp_extract_all(_col(c), F.lit(UNSIGNED_NUMBER), F.lit(0)))


def last_number_signed(c: ColumnOrName) -> Column:
    return _last(F.regexp_extract_all(_col(c), F.lit(SIGNED_NUMBER), F.lit(0)))


def think_format(c: ColumnOrName, sep: str = SEP_LOOSE) -> Column:
    """Thought block, separator, answer block and nothing after but one newline."""
    return _col(c).rlike(rf"(?sd)^<think>.*?</think>{sep}<answer>.*?</answer>$")


def tag_counts_ok(c: ColumnOrName) -> Column:
    """Exactly one opening and one closing tag's worth of each kind."""
    return (F.regexp_count(_col(c), F.lit("</?think>")) == 2) & (
        F.regexp_count(_col(c), F.lit("</?answer>")) == 2
    )


def think_format_strict(c: ColumnOrName, sep: str = SEP_LOOSE) -> Column:
    return think_format(c, sep) & tag_counts_ok(c)


def boxed_nested(c: ColumnOrName) -> Column:
    r"""Content of the last `\boxed{...}` with at most one level of braces inside.

    Innermost brace pairs are renamed first, so that the search itself needs no repeated group; the
    characters that name them are escaped before and restored afterwards.
    """
    x = F.when(F.contains(_col(c), F.lit("\\boxed{")), _col(c))
    for digit, char in ((2, _ESCAPE), (0, _OPEN), (1, _CLOSE)):
        x = F.replace(x, F.lit(char), F.lit(f"{_ESCAPE}{digit}"))
    leaves = F.regexp_replace(x, r"\{([^{}]*)\}", f"{_OPEN}$1{_CLOSE}")
    pattern = rf"\\boxed(?:{_OPEN}[^{{}}{_OPEN}{_CLOSE}]*{_CLOSE}|\{{[^{{}}]*\}})"
    hit = _last(F.regexp_extract_all(leaves, F.lit(pattern), F.lit(0)))
    inside = F.regexp_replace(hit, r"(?s)^\\boxed.|.\z", "")
    inside = F.translate(inside, _OPEN + _CLOSE, "{}")
    for digit, char in ((0, _OPEN), (1, _CLOSE), (2, _ESCAPE)):
        inside = F.replace(inside, F.lit(f"{_ESCAPE}{digit}"), F.lit(char))
    return inside


def dollar_math(c: ColumnOrName) -> Column:
    """Last `$...$`, stripped."""
    x = F.when(F.contains(_col(c), F.lit("$")), _col(c))
    return strip(_last(F.regexp_extract_all(x, F.lit(r"(?s)\$(.+?)\$"), F.lit(1))))


def boxed_or_dollar(c: ColumnOrName) -> Column:
    return F.coalesce(strip(boxed_nested(c)), dollar_math(c))


def answer_body(c: ColumnOrName) -> Column:
    """Text of the first answer block, stripped."""
    x = F.when(F.contains(_col(c), F.lit("<answer>")), _col(c))
    hits = F.regexp_extract_all(x, F.lit("(?s)<answer>(.*?)</answer>"), F.lit(1))
    return strip(F.try_element_at(hits, F.lit(1)))


def answer_in_body(body: ColumnOrName) -> Column:
    """The boxed or `$` math of an answer block, else all of it."""
    return F.coalesce(F.nullif(boxed_or_dollar(body), F.lit("")), _col(body))


def answer_tag(c: ColumnOrName) -> Column:
    """First answer block, reduced to the boxed or `$` math in it when there is some."""
    return _let(answer_body(c), answer_in_body)


def answer_outside(c: ColumnOrName) -> Column:
    """Boxed, else `$` math, else last signed number, else NULL."""
    return F.coalesce(boxed_or_dollar(c), last_number_signed(c))


def extract_math_answer(c: ColumnOrName) -> Column:
    """Answer block, else boxed, else `$` math, else last signed number, else NULL."""
    return F.coalesce(answer_tag(c), answer_outside(c))


def _unmarked(c: ColumnOrName) -> Column:
    x = strip(c)
    for mark in ("$", "\\,", "\\!"):
        x = F.replace(x, F.lit(mark), F.lit(""))
    return x


def _plain_latex(x: Column) -> Column:
    y = F.regexp_replace(x, rf"(?U)\\left{_WS}*(?=[()])", "")
    y = F.regexp_replace(y, rf"(?U)\\right{_WS}*(?=[()])", "")
    y = F.regexp_replace(y, r"(?d)\\text\{(.+?)\}", "$1")
    part = rf"\{{{_WS}*([^{{}}]+?){_WS}*\}}"
    y = F.regexp_replace(y, rf"(?U)\\frac{_WS}*{part}{_WS}*{part}", "($1)/($2)")
    # most answers hold no command and need none of the patterns
    return F.replace(F.when(F.contains(x, F.lit("\\")), y).otherwise(x), F.lit(" "), F.lit(""))


def normalize_latex(c: ColumnOrName) -> Column:
    """Drop `$`, spacing commands and blanks, unwrap text, write fractions as (a)/(b)."""
    return _let(_unmarked(c), _plain_latex)


_NUMBER = r"([0-9]+\.?[0-9]*|\.[0-9]+)"
_RATIONAL = rf"([+-]?)\(?([+-]?){_NUMBER}\)?(?:/\(?([+-]?){_NUMBER}\)?)?"
_THOUSANDS = r"[+-]?[0-9]{1,3}(?:,[0-9]{3})++(?:\.[0-9]+)?"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value that `body` uses many times, so that its expression occurs in the plan once.

    Plans over many rows bind by columns instead (see `with_math_correct`): lambdas are interpreted.
    """
    return F.transform(F.array(value), body)[0]


@cache
def _equal_values() -> Callable[[ColumnOrName, ColumnOrName], Column]:
    """The comparison of `math_equal` on Arrow batches. All it needs goes with it by value."""
    thousands, rational = re.compile(_THOUSANDS), re.compile(_RATIONAL)
    exact = decimal.Context(prec=decimal.MAX_PREC, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN, traps=[decimal.Inexact])
    number, spaces = decimal.Decimal, PY_WHITESPACE

    def fraction(text: str):
        """Numerator with its sign, and denominator; None when the text is no number."""
        found = rational.fullmatch(text)
        if found is None:
            return None
        *signs, top, sign, low = found.group(1, 2, 3, 4, 5)
        over = number(top)
        return (over.copy_negate() if (*signs, sign).count("-") % 2 else over), number(low or 1)

    def same(a: str | None, b: str | None) -> bool | None:
        if a is None or b is None:
            return None
        a, b = (x.replace(",", "") if thousands.fullmatch(x) else x for x in (a.strip(spaces), b.strip(spaces)))
        if a == b:
            return True
        x = fraction(a)
        y = x and fraction(b)
        if not y or not x[1] or not y[1]:
            return False
        return exact.multiply(x[0], y[1]) == exact.multiply(y[0], x[1])

    @F.pandas_udf("boolean")
    def equal(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same(x, y) for x, y in zip(a, b, strict=True)], dtype="object")

    return equal


def math_equal(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Equal as text or as exact rationals of any number of digits; NULL only if either side is NULL.

    Numbers are compared by the products across. A zero denominator equals nothing but its own text.
    """
    return _equal_values()(_col(a), _col(b))


def numeric_correct(answer: ColumnOrName, gold: ColumnOrName) -> Column:
    """The last number of the answer equals the gold number; no number is wrong."""
    return F.coalesce(math_equal(last_number(answer), gold), F.lit(False))


def math_correct(answer: ColumnOrName, gold: ColumnOrName) -> Column:
    """Cascade extraction, normalisation of both sides, then rational or text equality."""
    said, right = normalize_latex(extract_math_answer(answer)), normalize_latex(gold)
    return F.coalesce(math_equal(said, right), F.lit(False))


def with_math_correct(df: DataFrame, answer: str = "answer", gold: str = "gold", name: str = "correct") -> DataFrame:
    """`math_correct` in steps: a column used several times is computed once, in generated code."""
    steps = (
        ("_body", answer_body(answer)),
        ("_said", F.coalesce(answer_in_body("_body"), answer_outside(answer))),
        ("_a", _unmarked("_said")),
        ("_b", _unmarked(gold)),
        ("_a", _plain_latex(F.col("_a"))),
        ("_b", _plain_latex(F.col("_b"))),
        (name, F.coalesce(math_equal("_a", "_b"), F.lit(False))),
    )
    for column, value in steps:
        df = df.withColumn(column, value)
    return df.drop("_body", "_said", "_a", "_b")


def boxed_equal(answer: ColumnOrName, gold: ColumnOrName) -> Column:
    """Both sides need a box; equal to the whole gold text when rebuilt, or equal as math."""
    same_math = math_equal(normalize_latex(boxed_nested(answer)), normalize_latex(boxed_nested(gold)))
    boxes = F.struct(boxed_nested(answer).alias("a"), boxed_nested(gold).alias("b"))

    def rebuilt(s: Column) -> Column:
        return s["b"].isNotNull() & (F.concat(F.lit("\\boxed{"), s["a"], F.lit("}")) == _col(gold))

    return F.coalesce(_let(boxes, rebuilt), F.lit(False)) | F.coalesce(same_math, F.lit(False))


def python_block(c: ColumnOrName) -> Column:
    """First fenced Python block, stripped; the whole text where there is none."""
    return F.coalesce(strip(_fenced(c)), _col(c))


def python_block_flag(c: ColumnOrName) -> Column:
    return F.when(_fenced(c).isNotNull(), 1).otherwise(-1)


def _fenced(c: ColumnOrName) -> Column:
    hits = F.regexp_extract_all(_col(c), F.lit("(?s)```python\n(.*?)\n```"), F.lit(1))
    return F.try_element_at(hits, F.lit(1))


def python_block_loose(c: ColumnOrName) -> Column:
    """From the first Python fence to the next fence, by position; else a marker text."""
    x = _col(c)
    start = F.instr(x, CODE_FENCE)
    rest = x.substr(start + len(CODE_FENCE), F.length(x))
    end = F.instr(rest, FENCE)
    body = strip(rest.substr(F.lit(1), end - 1))
    return F.when((start > 0) & (end > 0), body).otherwise(F.lit(NO_CODE_TEXT))


def word_count(c: ColumnOrName) -> Column:
    """Number of whitespace-separated tokens."""
    return F.regexp_count(_col(c), F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def count_substring(c: ColumnOrName, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.regexp_count(_col(c), F.lit(rf"\Q{part}\E"))


def tool_score(c: ColumnOrName) -> Column:
    return (count_substring(c, CODE_FENCE) - count_substring(c, TOOL_ERROR)) * F.lit(0.1)


def strip_special(c: ColumnOrName, tokens: tuple[str, ...] = SPECIAL_TOKENS) -> Column:
    x = _col(c)
    for token in tokens:
        x = F.replace(x, F.lit(token), F.lit(""))
    return x


def requested_tool(c: ColumnOrName) -> Column:
    return F.endswith(_col(c), F.lit(TOOL_STOP_SENTENCE))


def insert_after_thought(c: ColumnOrName) -> Column:
    """Put an empty thought block right behind the first closing thought tag."""
    x = _col(c)
    at = F.instr(x, THINK_CLOSE)
    cut = at + len(THINK_CLOSE) - 1
    grown = F.concat(x.substr(F.lit(1), cut), F.lit(EMPTY_THINK), x.substr(cut + 1, F.length(x)))
    return F.when(at > 0, grown).otherwise(x)


def is_close(x: ColumnOrName, y: ColumnOrName, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    x, y = _col(x), _col(y)
    return F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)


def two_decimals(x: ColumnOrName) -> Column:
    return F.format_string("%.2f", _col(x).cast("double"))
