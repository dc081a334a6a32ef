"""Congestion state: completed trips per zone in five-minute buckets, rolling sums, point-in-time lookup.

State is keyed by the PICKUP zone at the DROP-OFF time: what a zone's own departures experienced.
All windows below run over at most one row per zone and bucket, so a zone with a third of all trips costs
no more than any other: 105,120 rows a year.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripspark.functions import clock
from tripspark.operators.lookups import null_safe
from tripspark.vocab import BUCKET_S, METRES_PER_MILE, STATE_MEASURES, WINDOWS_MIN


def completions(trips: DataFrame) -> DataFrame:
    """zone, bucket_s, completed, distance_m, duration_s for trips with a positive ride time."""
    return (
        trips.filter(F.col("trip_duration_s") > 0)
        .groupBy(F.col("pu_zone").alias("zone"), clock.bucket(F.col("dropoff_s")).alias("bucket_s"))
        .agg(
            F.count("*").alias("completed"),
            F.coalesce(F.sum(F.col("trip_miles") * METRES_PER_MILE), F.lit(0.0)).alias("distance_m"),
            F.sum("trip_duration_s").alias("duration_s"),
        )
    )


def state_columns(windows: Sequence[int] = WINDOWS_MIN) -> list[str]:
    return [f"{measure}_{w}m" for w in windows for measure in STATE_MEASURES]


def rolling_state(buckets: DataFrame, windows: Sequence[int] = WINDOWS_MIN) -> DataFrame:
    """Sums over (bucket - w, bucket] per zone; all windows share one sort."""
    ordered = Window.partitionBy("zone").orderBy("bucket_s")
    sums = [
        F.sum(measure).over(ordered.rangeBetween(1 - 60 * w, 0)).alias(f"{measure}_{w}m")
        for w in windows
        for measure in STATE_MEASURES
    ]
    return buckets.select("*", *sums)


def zone_state(trips: DataFrame, windows: Sequence[int] = WINDOWS_MIN) -> DataFrame:
    return rolling_state(completions(trips), windows)


def asof_by_bucket(keys: DataFrame, state: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each (zone, key_s): the last state row of the zone with ``bucket_s`` strictly before ``key_s``.

    Both sides are stacked and the last state row is carried forward in time order, so the work is one sort
    per zone and never a product of the two sides. A key sorts before the state of the same second.
    """
    payload = F.struct(F.col("bucket_s").alias("state_bucket_s"), *columns)
    left = keys.select("zone", F.col("key_s").alias("t"), F.lit(0).alias("side"), F.lit(None).alias("row"))
    right = state.select("zone", F.col("bucket_s").alias("t"), F.lit(1).alias("side"), payload.alias("row"))
    in_time = Window.partitionBy("zone").orderBy("t", "side")
    carried = F.last("row", ignorenulls=True).over(in_time.rowsBetween(Window.unboundedPreceding, -1))
    merged = left.unionByName(right).withColumn("row", carried).filter("side = 0")
    return merged.select("zone", F.col("t").alias("key_s"), "row.*")


def attach_state(requests: DataFrame, state: DataFrame, windows: Sequence[int] = WINDOWS_MIN) -> DataFrame:
    """Latest state of the pickup zone from a bucket before the request's own; null when there is none.

    Requests of one zone in one bucket share the answer. So the as-of step sees each (zone, bucket) once, and
    the requests then take a plain equi-join, which adaptive execution can split on a hot key.
    """
    columns = state_columns(windows)
    keyed = requests.withColumn("key_s", clock.bucket(F.col("request_s")))
    keys = keyed.select(F.col("pu_zone").alias("zone"), "key_s").filter("key_s IS NOT NULL").distinct()
    matched = asof_by_bucket(keys, state, columns).withColumnsRenamed(
        {"zone": "m_zone", "key_s": "m_key_s"}
    )
    on = [("pu_zone", "m_zone"), ("key_s", "m_key_s")]
    return keyed.join(matched, null_safe(keyed, matched, on), "left").drop("m_zone", "m_key_s", "key_s")


def last_state(state: DataFrame) -> DataFrame:
    """Newest state row per zone."""
    others = [c for c in state.columns if c != "zone"]
    return state.groupBy("zone").agg(F.max_by(F.struct(*others), "bucket_s").alias("row")).select("zone", "row.*")


def spread_to_ends(buckets: DataFrame, windows: Sequence[int] = WINDOWS_MIN) -> DataFrame:
    """Each bucket once for every bucket end within the longest window and the one after, as ``clock_s``."""
    longest = max(windows) * 60
    ends = F.explode(F.sequence(F.col("bucket_s"), F.col("bucket_s") + longest, F.lit(BUCKET_S)))
    return buckets.select("*", ends.alias("clock_s"))


def window_sums(windows: Sequence[int] = WINDOWS_MIN) -> list[Column]:
    """Sums over (clock - w, clock] of spread buckets."""
    age = F.col("clock_s") - F.col("bucket_s")
    return [
        F.sum(F.when(age < 60 * w, F.col(m)).otherwise(0)).alias(f"{m}_{w}m") for w in windows for m in STATE_MEASURES
    ]


def decayed_state(buckets: DataFrame, windows: Sequence[int] = WINDOWS_MIN) -> DataFrame:
    """State at every zone and bucket end within an hour of activity, empty windows counted as zero.

    Unlike ``rolling_state`` this keeps falling after a zone's last trip, as a running replay does. Each bucket
    adds to the bucket ends it is visible at, so there is no window sort at all.
    """
    return spread_to_ends(buckets, windows).groupBy("zone", "clock_s").agg(*window_sums(windows))
