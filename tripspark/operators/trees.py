"""Squared-loss trees on MLlib; quantile models are in ``boosting``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, functions as F

from tripspark.vocab import TARGET

# Trees split a missing value off by this number, which no feature takes.
MISSING = -1.0e6


@dataclass(frozen=True)
class TreeParams:
    rounds: int = 20
    rate: float = 0.3
    depth: int = 5
    min_rows: int = 50
    seed: int = 0


def vectorise(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds the ``features`` vector; missing values become MISSING."""
    filled = [F.coalesce(F.col(f).cast("double"), F.lit(MISSING)).alias(f"_f_{f}") for f in features]
    wide = frame.select("*", *filled)
    names = [f"_f_{f}" for f in features]
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names)


def fit_squared_loss(train: DataFrame, valid: DataFrame, params: TreeParams) -> GBTRegressionModel:
    """Boosted trees on the target; stops when the validation loss no longer falls."""
    both = train.select("features", TARGET, F.lit(False).alias("is_valid")).unionByName(
        valid.select("features", TARGET, F.lit(True).alias("is_valid"))
    )
    return GBTRegressor(
        labelCol=TARGET,
        maxIter=params.rounds,
        maxDepth=params.depth,
        stepSize=params.rate,
        minInstancesPerNode=params.min_rows,
        validationIndicatorCol="is_valid",
        seed=params.seed,
    ).fit(both)
