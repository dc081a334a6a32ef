"""Typed settings. They are checked when built, so a job never starts with levels it cannot serve."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripspark.vocab import HASH_MODULUS, TIERS, WINDOWS_MIN

_LEVEL_TOLERANCE = 1e-9


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def level_index(levels: tuple[float, ...], wanted: float) -> int:
    """Position of a trained level, equal up to rounding; never the nearest one."""
    for i, level in enumerate(levels):
        if abs(level - wanted) < _LEVEL_TOLERANCE:
            return i
    raise ValueError(f"level {wanted:.4f} is not among the trained levels {levels}")


@dataclass(frozen=True)
class CostConfig:
    lambda_late: float = 3.0
    lambda_early: float = 1.0

    def __post_init__(self) -> None:
        _require(min(self.lambda_late, self.lambda_early) > 0, "cost rates must be positive")

    @property
    def optimal_quantile(self) -> float:
        return self.lambda_late / (self.lambda_late + self.lambda_early)

    @property
    def pinball_factor(self) -> float:
        """Business cost is this many times the pinball loss at the optimal quantile."""
        return self.lambda_late + self.lambda_early


@dataclass(frozen=True)
class SplitConfig:
    train_start: dt.date = dt.date(2023, 1, 1)
    train_end: dt.date = dt.date(2023, 10, 1)
    cal_end: dt.date = dt.date(2023, 11, 15)
    val_end: dt.date = dt.date(2023, 12, 15)
    test_end: dt.date = dt.date(2024, 1, 15)
    holdout_weeks: int = 8

    def __post_init__(self) -> None:
        days = [self.train_start, self.train_end, self.cal_end, self.val_end, self.test_end]
        _require(all(a < b for a, b in zip(days, days[1:])), f"split bounds must increase: {days}")
        _require(self.holdout_weeks >= 1, "at least one holdout week is needed")

    @property
    def holdout_end(self) -> dt.date:
        return self.test_end + dt.timedelta(weeks=self.holdout_weeks)

    def upper_bounds(self) -> tuple[tuple[str, dt.date], ...]:
        """Each split with its exclusive end day, in time order."""
        return (
            ("train", self.train_end),
            ("cal", self.cal_end),
            ("val", self.val_end),
            ("test", self.test_end),
            ("holdout", self.holdout_end),
        )


@dataclass(frozen=True)
class SegmentConfig:
    peak_am: tuple[int, int] = (6, 10)
    peak_pm: tuple[int, int] = (16, 20)
    late_night: tuple[int, int] = (23, 5)
    short_below_miles: float = 2.0
    long_above_miles: float = 8.0
    rain_mm: float = 0.2
    snow_mm: float = 0.5
    airport_zones: tuple[int, ...] = (1, 132, 138)
    core_borough: str = "Manhattan"

    def __post_init__(self) -> None:
        _require(0 < self.short_below_miles < self.long_above_miles, "trip-length limits must be ordered")
        _require(min(self.rain_mm, self.snow_mm) >= 0, "weather limits cannot be negative")


@dataclass(frozen=True)
class ModelConfig:
    levels: tuple[float, ...] = (0.05, 0.5, 0.75, 0.9, 0.95)
    reported: tuple[float, ...] = (0.5, 0.75, 0.9)
    seeds: tuple[int, ...] = (0, 1, 2)

    def __post_init__(self) -> None:
        _require(all(a < b for a, b in zip(self.levels, self.levels[1:])), "levels must ascend without repeats")
        _require(all(0.0 < q < 1.0 for q in self.levels), "levels must lie strictly between 0 and 1")
        _require(len(self.seeds) >= 3, "three seeds or more: every headline is a mean with a spread")
        for level in self.reported:
            level_index(self.levels, level)


@dataclass(frozen=True)
class CalibrationConfig:
    target_coverage: float = 0.90
    min_cell_rows: int = 5_000

    def __post_init__(self) -> None:
        _require(0.0 < self.target_coverage < 1.0, "target coverage must lie strictly between 0 and 1")
        _require(self.min_cell_rows >= 1, "the cell floor must be positive")

    @property
    def risk(self) -> float:
        return 1.0 - self.target_coverage

    @property
    def bracket(self) -> tuple[float, float]:
        return round(self.risk / 2.0, 10), round(1.0 - self.risk / 2.0, 10)


@dataclass(frozen=True)
class Settings:
    cost: CostConfig = field(default_factory=CostConfig)
    splits: SplitConfig = field(default_factory=SplitConfig)
    segments: SegmentConfig = field(default_factory=SegmentConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    calibration: CalibrationConfig = field(default_factory=CalibrationConfig)
    windows_min: tuple[int, ...] = WINDOWS_MIN

    def __post_init__(self) -> None:
        # Both lookups raise when the level is missing.
        _ = self.served_index, self.interval_indexes

    @property
    def served_index(self) -> int:
        return level_index(self.model.levels, self.cost.optimal_quantile)

    @property
    def interval_indexes(self) -> tuple[int, int]:
        lo, hi = self.calibration.bracket
        return level_index(self.model.levels, lo), level_index(self.model.levels, hi)


def tier_threshold(tier: str) -> int:
    _require(tier in TIERS, f"unknown sampling tier {tier!r}")
    _require(TIERS[tier] <= HASH_MODULUS, "a tier cannot exceed the modulus")
    return TIERS[tier]


# ---- tables of settings ----------------------------------------------------------------------------------


def _holds(levels: Column, wanted: Column) -> Column:
    return F.exists(levels, lambda level: F.abs(level - wanted) < _LEVEL_TOLERANCE)


def check_settings(settings: DataFrame) -> DataFrame:
    """The same checks for a table of settings: lambda_late, lambda_early, levels, coverage, seeds.

    Adds ``served_level`` and whether it is trained (``serves``), whether both interval levels are (``brackets``), whether
    levels ascend within (0, 1) and whether there are three seeds or more. A null setting fails its checks.
    """
    late, early, levels = F.col("lambda_late"), F.col("lambda_early"), F.col("levels")
    served = F.when((late > 0) & (early > 0), late / (late + early))
    low = (1.0 - F.col("coverage")) / 2.0
    steps = F.zip_with(F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0))), levels, lambda b, a: b.isNull() | (b > a))
    within = F.forall(levels, lambda level: (level > 0) & (level < 1))
    checks = {
        "serves": _holds(levels, served),
        "brackets": _holds(levels, low) & _holds(levels, 1.0 - low),
        "ascends": F.forall(steps, lambda ok: ok) & within & (F.size(levels) > 0),
        "enough_seeds": F.size(F.array_distinct("seeds")) >= 3,
    }
    return settings.withColumn("served_level", served).withColumns(
        {name: F.coalesce(check, F.lit(False)) for name, check in checks.items()}
    )
