"""Do two ways of computing the features agree?"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tripspark.operators.lookups import null_safe

EXACT_TYPES = {"boolean", "tinyint", "smallint", "int", "bigint", "string"}


def _number(name: str, dtype: str) -> Column:
    value = F.col(name)
    if dtype in ("float", "double"):
        return F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return value.cast("int").cast("double") if dtype == "boolean" else value.cast("double")


def check_parity(
    left: DataFrame, right: DataFrame, key: str, features: Sequence[str], tolerance: float = 1e-5
) -> DataFrame:
    """Per feature: rows, mismatches, worst difference. Rows are matched on ``key``; a row on one side only counts
    as a mismatch of every feature.

    Whole numbers and flags must be equal; other numbers may differ by ``tolerance`` relative to the larger of the
    two and 1. Null and NaN are the same kind of missing, and agreed missing is no difference.
    """
    types = dict(left.dtypes)
    other = right.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_r_{f}") for f in features])
    pairs = left.select(key, *features).join(other, null_safe(left, other, [(key, "_key")]), "full")
    alone = F.col(key).isNull() | F.col("_key").isNull()
    return compare_columns(pairs, {f: (f, f"_r_{f}", types[f]) for f in features}, tolerance, alone)


def compare_columns(
    pairs: DataFrame, features: Mapping[str, tuple[str, str, str]], tolerance: float = 1e-5, alone: Column | None = None
) -> DataFrame:
    """The same report for two columns of one row: ``features`` names the left column, the right one and the type.

    Rows for which ``alone`` holds count as a mismatch of every feature.
    """
    per_feature = []
    for f, (mine, theirs, dtype) in features.items():
        a, b = _number(mine, dtype), _number(theirs, dtype)
        both_missing = a.isNull() & b.isNull()
        gap = F.abs(a - b)
        if dtype not in EXACT_TYPES:
            gap = gap / F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
        limit = 0.0 if dtype in EXACT_TYPES else tolerance
        same = both_missing | F.coalesce(gap <= limit, F.lit(False))
        if alone is not None:
            same = ~alone & same
        per_feature.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.count_if(~same).alias("mismatches"),
                F.coalesce(F.max(gap), F.lit(0.0)).alias("worst"),
            ).alias(f"_o_{f}")
        )
    wide = pairs.agg(F.count("*").alias("rows"), *per_feature)
    return wide.select("rows", F.inline(F.array(*[F.col(f"_o_{f}") for f in features])))


def is_clean(report: DataFrame) -> bool:
    return report.filter("mismatches > 0").isEmpty()
