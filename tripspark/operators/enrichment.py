"""Clean trips to enriched trips: weather, segments, split, holdout week."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tripspark.config import Settings
from tripspark.functions import segments
from tripspark.operators.lookups import join_lookup
from tripspark.operators.weather import join_weather


def density_by_zone(zones: DataFrame, settings: Settings) -> DataFrame:
    return zones.select(
        F.col("zone_id").alias("pu_zone"),
        segments.density_bucket(F.col("zone_id"), F.col("borough"), settings.segments).alias("seg_zone_density"),
    )


def assign_segments(trips: DataFrame, density: DataFrame, settings: Settings) -> DataFrame:
    cfg = settings.segments
    tagged = trips.withColumns(
        {
            "seg_time": segments.time_bucket(F.col("request_local_s"), cfg),
            "seg_trip_length": segments.trip_length_bucket(F.col("trip_miles"), cfg),
            "seg_weather": segments.weather_bucket(F.col("temp_c"), F.col("precip_mm_h"), cfg),
        }
    )
    return join_lookup(tagged, density, ["pu_zone"])


def assign_split(trips: DataFrame, settings: Settings) -> DataFrame:
    local = F.col("request_local_s")
    split = trips.withColumn("split", segments.split_of(local, settings.splits))
    return split.withColumn("holdout_week", segments.holdout_week(local, F.col("split"), settings.splits))


def enrich(
    clean: DataFrame, weather: DataFrame, zones: DataFrame, stations: DataFrame, settings: Settings
) -> DataFrame:
    """All months in one job; every join is with a zone-sized or calendar-sized table."""
    with_weather = join_weather(clean, weather, stations)
    with_segments = assign_segments(with_weather, density_by_zone(zones, settings), settings)
    return assign_split(with_segments, settings)
