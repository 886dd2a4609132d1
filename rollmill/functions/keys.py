"""Seeded order keys: the same draw on every run, engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollmill.functions.text import ColumnOrName, _col


def seeded_key(seed: int | str, *ids: ColumnOrName) -> Column:
    """A uniform 32-digit hexadecimal key; sorting by it is a random order fixed by the seed.

    Its leading digits cut the order into equal buckets, see `rollmill.operators.scan`.
    """
    parts = [F.lit(str(seed)), *(_col(i).cast("string") for i in ids)]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))
