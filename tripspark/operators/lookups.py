"""Joins with small tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame


def join_lookup(frame: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table that has one row per key; ``table`` must be unique on ``on``: every caller aggregates by these keys.

    Lookup tables are written, so the planner knows their size: it broadcasts one that is small and shuffles one that is
    not. No row of either side is filtered.
    """
    return frame.join(table, list(on), how)


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (left[x].eqNullSafe(right[y]) for x, y in pairs))
