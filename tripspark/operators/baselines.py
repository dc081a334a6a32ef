"""Baselines fitted from grouped sums: historical mean and the free-flow multiplier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tripspark.functions import clock
from tripspark.operators.lookups import join_lookup
from tripspark.session import materialize
from tripspark.vocab import MIN_HOUR_ROWS, MIN_PAIR_ROWS, TARGET

_PAIR = ["pu_zone", "do_zone"]


@dataclass(frozen=True)
class HistoricalMean:
    """Mean target of the zone pair in that hour, else of the pair, else of everything."""

    pair_hour: DataFrame
    pair: DataFrame
    overall: DataFrame

    def predict(self, frame: DataFrame, output: str = "prediction") -> DataFrame:
        hour = clock.hour(F.col("request_local_s"))
        keyed = frame.withColumn("_hour", hour)
        keyed = join_lookup(keyed, self.pair_hour, [*_PAIR, "_hour"])
        keyed = join_lookup(keyed, self.pair, _PAIR)
        value = F.coalesce("pair_hour_mean", "pair_mean", self.overall.scalar())
        return keyed.withColumn(output, value).drop("_hour", "pair_hour_mean", "pair_mean")


def fit_historical_mean(train: DataFrame, min_rows: int = MIN_PAIR_ROWS) -> HistoricalMean:
    """One pass over the rows; the pair and overall means come from the pair-hour sums.

    The sums are bounded by zones squared times 24 hours and are written, so predictions do not refit.
    """
    sums = materialize(
        train.groupBy(*_PAIR, clock.hour(F.col("request_local_s")).alias("_hour")).agg(
            F.sum(TARGET).alias("total"), F.count(TARGET).alias("n")
        ),
        "pair-hour-sums",
    )
    pairs = sums.groupBy(*_PAIR).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.col("total") / F.col("n")
    return HistoricalMean(
        pair_hour=sums.filter(F.col("n") >= min_rows).select(*_PAIR, "_hour", mean.alias("pair_hour_mean")),
        pair=pairs.filter(F.col("n") >= min_rows).select(*_PAIR, mean.alias("pair_mean")),
        overall=sums.agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean")),
    )


@dataclass(frozen=True)
class FreeFlowMultiplier:
    """Target as a multiple of the free-flow time, per hour where enough rows, else overall."""

    by_hour: DataFrame
    overall: DataFrame
    mean: DataFrame

    def predict(self, frame: DataFrame, output: str = "prediction") -> DataFrame:
        keyed = frame.withColumn("_hour", clock.hour(F.col("request_local_s")))
        # At most 24 rows.
        keyed = keyed.join(F.broadcast(self.by_hour), "_hour", "left")
        multiplier = F.coalesce("hour_multiplier", self.overall.scalar())
        usable = F.col("free_flow_duration_s") > 0
        value = F.when(usable, F.col("free_flow_duration_s") * multiplier).otherwise(self.mean.scalar())
        return keyed.withColumn(output, value).drop("_hour", "hour_multiplier")


def fit_free_flow_multiplier(train: DataFrame, min_rows: int = MIN_HOUR_ROWS) -> FreeFlowMultiplier:
    """Least squares through the origin from grouped sums: sum(xy) / sum(x^2) over rows with x > 0."""
    x = F.when(F.col("free_flow_duration_s") > 0, F.col("free_flow_duration_s").cast("double"))
    sums = materialize(
        train.groupBy(clock.hour(F.col("request_local_s")).alias("_hour")).agg(
            F.sum(x * F.col(TARGET)).alias("xy"),
            F.sum(x * x).alias("xx"),
            F.count(x).alias("n"),
            F.sum(TARGET).alias("total"),
            F.count(TARGET).alias("rows"),
        ),
        "multiplier-sums",
    )
    return FreeFlowMultiplier(
        by_hour=sums.filter(F.col("n") >= min_rows).select(
            "_hour", F.try_divide(F.col("xy"), F.col("xx")).alias("hour_multiplier")
        ),
        overall=sums.agg(F.try_divide(F.sum("xy"), F.sum("xx")).alias("m")),
        mean=sums.agg(F.try_divide(F.sum("total").cast("double"), F.sum("rows")).alias("m")),
    )
