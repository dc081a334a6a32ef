"""Row rules, their audit, and the target with its components.

Input columns: the instants ``request_s``, ``on_scene_s``, ``pickup_s``, ``dropoff_s``, the wall clock
``request_local_s``, ``pu_zone``, ``do_zone``, ``trip_miles``, ``trip_time``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tripspark.functions import clock
from tripspark.vocab import (
    COMPONENTS,
    MAX_DISPATCH_S,
    MAX_MPH,
    MAX_ROUTABLE_ZONE,
    MAX_TRIP_S,
    TARGET,
    UNKNOWN_ZONES,
)


# The rules' names, in the order of the report.
RULE_NAMES = (
    "timestamps_present",
    "timestamps_ordered",
    "positive_duration",
    "duration_under_6h",
    "dispatch_under_2h",
    "distance_consistent",
    "speed_plausible",
    "zones_routable",
)


def rules() -> dict[str, Column]:
    """Name and keep-condition of each rule; a null condition rejects the row."""
    request, pickup, dropoff = F.col("request_s"), F.col("pickup_s"), F.col("dropoff_s")
    miles, ride = F.col("trip_miles"), F.col("trip_time")
    total = dropoff - request

    def routable(zone: str) -> Column:
        return F.col(zone).between(1, MAX_ROUTABLE_ZONE) & ~F.col(zone).isin(*UNKNOWN_ZONES)

    keep = (
        request.isNotNull() & pickup.isNotNull() & dropoff.isNotNull(),
        pickup.between(request, dropoff),
        total > 0,
        total <= MAX_TRIP_S,
        (pickup - request) <= MAX_DISPATCH_S,
        ~((miles <= 0) & (ride > 0)),
        # Multiplied out, so no division by a zero time.
        (ride <= 0) | (miles * 3600 <= MAX_MPH * ride),
        routable("pu_zone") & routable("do_zone"),
    )
    return dict(zip(RULE_NAMES, keep, strict=True))


def _kept(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def keep_all() -> Column:
    return reduce(lambda a, b: a & b, map(_kept, rules().values()))


def apply_rules(trips: DataFrame) -> DataFrame:
    return trips.filter(keep_all())


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 4), F.lit(0.0))


def audit(trips: DataFrame) -> DataFrame:
    """One pass: rows and, for each rule alone, how many it rejects. Columns rule, rows, rejected, pct."""
    counted = trips.agg(
        F.count("*").alias("rows"),
        *[F.count_if(~_kept(rule)).alias(name) for name, rule in rules().items()],
    )
    long = counted.unpivot("rows", list(RULE_NAMES), "rule", "rejected")
    return long.select("rule", "rows", "rejected", _percent(F.col("rejected"), F.col("rows")).alias("pct"))


def monthly_report(trips: DataFrame) -> DataFrame:
    """Rows in, out and dropped per request month, with a total line, and each rule's own rejections."""
    dated = trips.withColumn("month", clock.month_label(F.col("request_local_s")))
    report = dated.rollup("month").agg(
        F.grouping("month").cast("int").alias("is_total"),
        F.count("*").alias("rows_in"),
        F.count_if(keep_all()).alias("rows_out"),
        *[F.count_if(~_kept(rule)).alias(name) for name, rule in rules().items()],
    )
    dropped = F.col("rows_in") - F.col("rows_out")
    return report.select(
        F.when(F.col("is_total") == 1, "all").otherwise(F.coalesce("month", F.lit("unknown"))).alias("month"),
        "rows_in",
        "rows_out",
        dropped.alias("rows_dropped"),
        _percent(dropped, F.col("rows_in")).alias("pct_dropped"),
        *RULE_NAMES,
    )


def with_target(trips: DataFrame) -> DataFrame:
    """Door-to-door seconds and their three parts; parts that need the arrival time are null without it."""
    request, scene = F.col("request_s"), F.col("on_scene_s")
    pickup, dropoff = F.col("pickup_s"), F.col("dropoff_s")
    return trips.withColumns(
        {
            TARGET: dropoff - request,
            "dispatch_approach_s": scene - request,
            "curb_wait_s": pickup - scene,
            "trip_duration_s": dropoff - pickup,
        }
    )


def _component_gap() -> Column:
    return F.abs(reduce(lambda a, b: a + b, map(F.col, COMPONENTS)) - F.col(TARGET))


def unreconciled(trips: DataFrame, tolerance_s: float = 1.0) -> DataFrame:
    """Rows whose parts do not add up to the target."""
    return trips.filter(_component_gap() > tolerance_s)


def component_complete(trips: DataFrame, tolerance_s: float = 1.0) -> DataFrame:
    """Rows with all parts known that add up; a null part makes the sum null and drops the row."""
    return trips.filter(_component_gap() <= tolerance_s)


def clean(trips: DataFrame) -> DataFrame:
    return with_target(apply_rules(trips))
