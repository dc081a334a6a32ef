import pytest
from pyspark.sql import functions as F

from tripspark.operators import calibration, lookups, weather


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_automatic_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def test_lookups_are_left_to_the_planner(spark, no_automatic_broadcast):
    big, table = spark.range(1000).withColumnRenamed("id", "k"), spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    joined = lookups.join_lookup(big, table, ["k"])
    assert "Broadcast" not in plan(joined)
    assert joined.filter("v = 1").count() == 50 and joined.count() == 1000


def test_zones_outside_the_usual_range_find_their_row(spark):
    trips = spark.createDataFrame([(1,), (265,), (266,), (-3,)], "pu_zone long")
    table = spark.range(0, 1000).select(F.col("id").alias("pu_zone"), F.lit(7).alias("v"))
    got = {r["pu_zone"]: r["v"] for r in lookups.join_lookup(trips, table, ["pu_zone"]).collect()}
    assert got == {1: 7, 265: 7, 266: 7, -3: None}


def test_unknown_buckets_stay(spark, no_automatic_broadcast):
    """100 scores, 40 of them in a bucket that no list has: both cells fall back to all rows."""
    rows = [(f"t{i}", 100.0 + i, 0.0, 100.0, "fog" if i < 40 else "clear") for i in range(100)]
    cal = spark.createDataFrame(rows, "trip_id string, actual double, lo double, hi double, seg_weather string")
    cells = {r["seg_weather"]: (r["q_s"], r["n"]) for r in calibration.mondrian_conformal(cal, 0.1, ["seg_weather"], 80).collect()}
    assert cells == {"fog": (90.0, 100), "clear": (90.0, 100)}
    assert calibration.split_conformal(cal, 0.1).first()["q_s"] == 90.0


def test_no_calibration_rows_leave_the_interval_open(spark):
    schema = "k string, actual double, lo double, hi double"
    cal = spark.createDataFrame([("a", 1.0, 0.0, 2.0)] * 50, schema)
    test = spark.createDataFrame([("a", 1.0, 0.0, 2.0), ("b", 1.0, 0.0, 2.0)], schema)
    widths = calibration.split_conformal(cal, 0.1, ["k"])
    got = {r["k"]: (r["lo"], r["hi"]) for r in calibration.apply_split(test, widths, ["k"]).collect()}
    assert got["b"] == (-float("inf"), float("inf")) and got["a"][1] < 10
    none = calibration.split_conformal(cal.limit(0), 0.1)
    assert [(r["q_s"], r["n"]) for r in none.collect()] == [(float("inf"), 0)]


def test_stations_outside_the_list_keep_their_hours(spark):
    schema = "station string, hour_s long, temp_c double, wind_ms double, visibility_m double, precip_mm_h double, snow_depth_cm double"
    hours = spark.createDataFrame([("buoy", 0, 1.0, 2.0, 3.0, 0.5, 7.0)], schema)
    got = {r["station"]: r["temp_c"] for r in weather.fill_gaps(hours).collect()}
    assert got["buoy"] == 1.0 and len(got) > 1
