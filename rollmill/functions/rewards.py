"""Reward expressions and the registry of pluggable rewards."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollmill.functions.text import ColumnOrName, _col

# --- fixed values: reward levels ---------------------------------------------------------------
RIGHT, WRONG = 1.0, -1.0
FORMAT_OK, FORMAT_BAD = 1.25, -1.0
TIER_BOTH, TIER_FORMAT, TIER_NONE = 2.0, 0.5, -2.0
REWARD_BINS = ("-2.00", "0.00", "0.25", "2.25")
LATE_POLICY_VERSION = 16
# -----------------------------------------------------------------------------------------------


def _level(flag: ColumnOrName, yes: float, no: float) -> Column:
    return F.when(_col(flag), F.lit(yes)).otherwise(F.lit(no))


def correct_reward(correct: ColumnOrName) -> Column:
    return _level(correct, RIGHT, WRONG)


def format_reward(fmt: ColumnOrName) -> Column:
    return _level(fmt, FORMAT_OK, FORMAT_BAD)


def sum_reward(correct: ColumnOrName, fmt: ColumnOrName) -> Column:
    return correct_reward(correct) + format_reward(fmt)


def tier_reward(correct: ColumnOrName, fmt: ColumnOrName) -> Column:
    return (
        F.when(_col(fmt) & _col(correct), F.lit(TIER_BOTH))
        .when(_col(fmt), F.lit(TIER_FORMAT))
        .otherwise(F.lit(TIER_NONE))
    )


def scheduled_reward(
    acc: ColumnOrName, fmt: ColumnOrName, tool: ColumnOrName, version: ColumnOrName
) -> Column:
    """Format and tool use weigh double for early policies, accuracy for later ones."""
    acc, fmt, tool = _col(acc), _col(fmt), _col(tool)
    return F.when(_col(version) >= LATE_POLICY_VERSION, 2 * acc + fmt + tool).otherwise(
        acc + 2 * fmt + 2 * tool
    )


def code_format_reward(fence_flag: ColumnOrName, ids: ColumnOrName | None = None, eos: int | None = None) -> Column:
    """1 when a fence was found and, if token ids are given, the end token is among them."""
    found = _col(fence_flag) == 1
    if ids is not None:
        found = found & F.array_contains(_col(ids), eos)
    return _level(found, RIGHT, WRONG)


def export_rewards(correct: ColumnOrName, loose: ColumnOrName, strict: ColumnOrName) -> list[Column]:
    return [
        _level(correct, RIGHT, WRONG).alias("correct_reward"),
        _level(loose, FORMAT_OK, FORMAT_BAD).alias("format_reward"),
        _level(strict, RIGHT, WRONG).alias("format_reward_strict"),
    ]


class RewardSet:
    """Named reward functions with weights, applied together in one projection.

    A reward maps the answer and gold columns to a double Column, so built-in expressions stay in
    the generated code; a user's `pandas_udf` has the same call shape and fits the same slot.
    """

    def __init__(self) -> None:
        self._rewards: dict[str, tuple[Callable[[Column, Column], Column], float]] = {}

    def register_reward(
        self, name: str, fn: Callable[[Column, Column], Column], weight: float = 1.0
    ) -> RewardSet:
        if name in self._rewards:
            raise ValueError(f"reward {name!r} is already registered")
        self._rewards[name] = (fn, weight)
        return self

    def apply(self, df: DataFrame, answer: str = "answer", gold: str = "gold") -> DataFrame:
        """Add one column per reward and their weighted sum as `reward`."""
        if not self._rewards:
            raise ValueError("no reward is registered")
        scored = df.withColumns(
            {name: fn(F.col(answer), F.col(gold)) for name, (fn, _) in self._rewards.items()}
        )
        weighted = [F.lit(w) * F.col(name) for name, (_, w) in self._rewards.items()]
        return scored.withColumn("reward", reduce(lambda x, y: x + y, weighted))
