"""Expressions over arrays: ascending quantile rows, non-negative increments, cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sort_row(q: Column) -> Column:
    return F.array_sort(q)


def running_max(q: Column) -> Column:
    """Raise each level to at least the level below it."""
    return F.transform(q, lambda _x, i: F.array_max(F.slice(q, F.lit(1), i + 1)))


def steps(q: Column) -> Column:
    """Differences between neighbouring levels."""
    return F.transform(
        F.sequence(F.lit(1), F.size(q) - 1), lambda i: F.element_at(q, i + 1) - F.element_at(q, i)
    )


def is_monotone(q: Column) -> Column:
    return F.forall(steps(q), lambda d: d >= 0)


def softplus(x: Column) -> Column:
    # The split keeps exp() from overflowing for large inputs.
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def ordered_heads(base: Column, raw: Column) -> Column:
    """Base level followed by the base plus cumulated softplus increments."""
    increments = F.transform(raw, softplus)
    tail = F.transform(
        increments,
        lambda _x, i: base + F.aggregate(F.slice(increments, F.lit(1), i + 1), F.lit(0.0), lambda a, b: a + b),
    )
    return F.concat(F.array(base), tail)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null when a side is missing or has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
