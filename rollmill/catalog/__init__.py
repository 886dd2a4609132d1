"""Registered queries over the test tables, one or more per operator."""

from __future__ import annotations

import importlib

MODULES = (
    "group_queries",
    "text_queries",
    "reward_queries",
    "eval_queries",
    "batch_queries",
    "token_queries",
    "prompt_queries",
    "source_queries",
    "stream_queries",
)


def load() -> tuple[dict, dict]:
    """All queries and all SQL twins."""
    for module in MODULES:
        importlib.import_module(f"rollmill.catalog.{module}")
    from rollmill.catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
