"""Segment buckets and wall-clock splits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tripspark.config import SegmentConfig, SplitConfig
from tripspark.functions import clock


def time_bucket(local_s: Column, cfg: SegmentConfig) -> Column:
    hour = clock.hour(local_s)
    night_from, night_to = cfg.late_night

    def within(span: tuple[int, int]) -> Column:
        return (hour >= span[0]) & (hour < span[1])

    return (
        F.when(hour.isNull(), None)
        .when((hour >= night_from) | (hour < night_to), "late_night")
        .when(within(cfg.peak_am), "peak_am")
        .when(within(cfg.peak_pm), "peak_pm")
        .otherwise("off_peak")
    )


def trip_length_bucket(miles: Column, cfg: SegmentConfig) -> Column:
    return (
        F.when(miles < cfg.short_below_miles, "short")
        .when(miles > cfg.long_above_miles, "long")
        .when(miles.isNotNull(), "medium")
    )


def weather_bucket(temp_c: Column, precip_mm_h: Column, cfg: SegmentConfig) -> Column:
    rain = F.coalesce(precip_mm_h, F.lit(0.0))
    return (
        F.when((temp_c <= 0) & (rain >= cfg.snow_mm), "snow").when(rain >= cfg.rain_mm, "rain").otherwise("clear")
    )


def density_bucket(zone: Column, borough: Column, cfg: SegmentConfig) -> Column:
    return (
        F.when(zone.isin(*cfg.airport_zones), "airport")
        .when(borough == cfg.core_borough, "manhattan_core")
        .otherwise("outer_borough")
    )


def split_of(local_s: Column, cfg: SplitConfig) -> Column:
    """Half-open ranges of request days; anything outside them is ``beyond``."""
    day = clock.epoch_day(local_s)
    out = F.when(day.isNull() | (day < clock.day_of(cfg.train_start.isoformat())), "beyond")
    for name, end in cfg.upper_bounds():
        out = out.when(day < clock.day_of(end.isoformat()), name)
    return out.otherwise("beyond")


def holdout_week(local_s: Column, split: Column, cfg: SplitConfig) -> Column:
    days = clock.epoch_day(local_s) - clock.day_of(cfg.test_end.isoformat())
    week = F.floor(days / F.lit(7))
    return F.when(split == "holdout", F.greatest(F.lit(0), F.least(F.lit(255), week)).cast("smallint"))


def segment_key(*buckets: Column) -> Column:
    return F.concat_ws("|", F.array_sort(F.array(*buckets)))
