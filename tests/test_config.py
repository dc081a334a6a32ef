import datetime as dt

import pytest

from tripspark.config import CalibrationConfig, CostConfig, ModelConfig, SegmentConfig, Settings, SplitConfig, tier_threshold


def test_defaults_are_consistent():
    s = Settings()
    assert s.cost.optimal_quantile == 0.75
    assert s.served_index == 2
    assert s.interval_indexes == (0, 4)
    assert s.cost.pinball_factor == 4.0


@pytest.mark.parametrize(
    "build",
    [
        lambda: Settings(cost=CostConfig(lambda_late=2.0)),
        lambda: Settings(calibration=CalibrationConfig(target_coverage=0.8)),
        lambda: SplitConfig(train_end=dt.date(2024, 1, 1)),
        lambda: ModelConfig(seeds=(0, 1)),
        lambda: ModelConfig(levels=(0.5, 0.05)),
        lambda: ModelConfig(levels=(0.5, 1.0)),
        lambda: ModelConfig(levels=(0.05, 0.5, 0.95)),
        lambda: SegmentConfig(short_below_miles=9.0),
        lambda: CostConfig(lambda_early=0.0),
        lambda: tier_threshold("huge"),
    ],
)
def test_bad_settings_are_refused(build):
    with pytest.raises(ValueError):
        build()


def test_holdout_end():
    assert SplitConfig().holdout_end == dt.date(2024, 3, 11)
