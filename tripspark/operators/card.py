"""Data card: one aggregate job over the enriched trips instead of one scan per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tripspark.operators.orderstats import Quantile, group_quantiles
from tripspark.vocab import SEGMENT_COLUMNS, TARGET

CARD_QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def value_counts(trips: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Rows per axis bucket and target second, for all rows (axis ``all``) and each axis alone.

    The target is whole seconds under six hours, so this is at most 21,600 rows per bucket and every exact
    quantile below is read from it.
    """
    sets = [[], *[[a] for a in axes]]
    counted = trips.groupingSets([[F.col(c) for c in s] + [F.col(TARGET)] for s in sets], *axes, TARGET).agg(
        F.count("*").alias("rows"), *[F.grouping(a).alias(f"_{a}") for a in axes]
    )
    axis, bucket = F.lit("all"), F.lit("all")
    for a in axes:
        axis = F.when(F.col(f"_{a}") == 0, a).otherwise(axis)
        bucket = F.when(F.col(f"_{a}") == 0, F.col(a)).otherwise(bucket)
    return counted.select(axis.alias("axis"), bucket.alias("bucket"), TARGET, "rows")


def overall(trips: DataFrame) -> DataFrame:
    """Count, mean, spread, range and nearest-rank quantiles of the target."""
    counts = value_counts(trips, [])
    basic = trips.agg(
        F.count("*").alias("rows"),
        F.avg(TARGET).alias("mean"),
        F.stddev_samp(TARGET).alias("std"),
        F.min(TARGET).alias("min"),
        F.max(TARGET).alias("max"),
    ).withColumn("axis", F.lit("all"))
    nearest = {name: Quantile(q, "nearest") for name, q in CARD_QUANTILES.items()}
    ranked = group_quantiles(counts, ["axis"], TARGET, nearest, weight="rows").drop("n")
    return basic.join(ranked, "axis").drop("axis")


def by_bucket(trips: DataFrame, axes: Sequence[str] = ("split", *SEGMENT_COLUMNS)) -> DataFrame:
    """Rows, share, median and nearest-rank p90 of the target for each bucket of each axis."""
    counts = value_counts(trips, axes).filter("axis <> 'all'")
    wanted = {"p50": Quantile(0.5), "p90": Quantile(0.9, "nearest")}
    stats = group_quantiles(counts, ["axis", "bucket"], TARGET, wanted, weight="rows")
    rows = stats.groupBy("axis").agg(F.sum("n").alias("axis_rows"))
    return stats.join(rows, "axis").select(
        "axis",
        "bucket",
        F.col("n").alias("rows"),
        (F.col("n") * 100.0 / F.col("axis_rows")).alias("share_pct"),
        "p50",
        "p90",
    )


def missingness(trips: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent of nulls per column."""
    wide = trips.agg(*[(F.avg(F.col(c).isNull().cast("int")) * 100.0).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "missing_pct")


def grid(cal: DataFrame, axes: Sequence[str] = SEGMENT_COLUMNS) -> DataFrame:
    return cal.groupBy(*axes).agg(F.count("*").alias("rows"))


def grid_viability(cal: DataFrame, floor: int, axes: Sequence[str] = SEGMENT_COLUMNS) -> DataFrame:
    """How many cells the calibration rows fall into and how many of those are thin."""
    thin = F.col("rows") < floor
    return grid(cal, axes).agg(
        F.count("*").alias("cells"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count_if(thin).alias("thin_cells"),
        F.coalesce(F.sum(F.when(thin, F.col("rows"))), F.lit(0)).alias("rows_in_thin_cells"),
        F.min("rows").alias("smallest"),
    )


def thinnest_cells(cal: DataFrame, floor: int, k: int = 8, axes: Sequence[str] = SEGMENT_COLUMNS) -> DataFrame:
    """The k smallest cells under the floor; ties go in bucket order."""
    return grid(cal, axes).filter(F.col("rows") < floor).orderBy("rows", *axes).limit(k)
