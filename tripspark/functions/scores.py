"""Costs, losses and interval scores of a promise. A null input gives a null score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tripspark.config import CostConfig


def _at_least(x: Column, floor: Column) -> Column:
    """Like greatest(), but null stays null."""
    return F.when(x.isNotNull() & floor.isNotNull(), F.greatest(x, floor))


def clip_low(x: Column, floor: float) -> Column:
    return _at_least(x, F.lit(floor))


def business_cost(actual: Column, promised: Column, cfg: CostConfig) -> Column:
    delay = actual - promised
    return cfg.lambda_late * clip_low(delay, 0.0) + cfg.lambda_early * clip_low(-delay, 0.0)


def pinball(actual: Column, predicted: Column, q: float) -> Column:
    delay = actual - predicted
    return _at_least(delay * F.lit(q), delay * F.lit(q - 1.0))


def is_late(actual: Column, promised: Column) -> Column:
    return actual > promised


def conformity(actual: Column, lo: Column, hi: Column) -> Column:
    """How far outside the interval a value fell; negative inside."""
    return _at_least(lo - actual, actual - hi)


def covers(actual: Column, lo: Column, hi: Column) -> Column:
    return actual.between(lo, hi)


def share(flag: Column) -> Column:
    """Share of rows where the flag holds, as an aggregate."""
    return F.avg(flag.cast("int"))
