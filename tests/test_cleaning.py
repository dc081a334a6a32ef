import datetime as dt

import pytest
from pyspark.sql import functions as F

from tripspark.functions import clock, sampling, segments
from tripspark.config import SegmentConfig, SplitConfig
from tripspark.operators import cleaning
from tripspark.sources import trip_files

SCHEMA = """operator string, request_s long, request_local_s long, on_scene_s long, pickup_s long, dropoff_s long,
pu_zone long, do_zone long, trip_miles double, trip_time long"""


def trip(request=0, scene=200, pickup=300, dropoff=1200, pu=10, do=20, miles=3.0, ride=900):
    return ("HV0003", request, request, scene, pickup, dropoff, pu, do, miles, ride)


ROWS = [
    trip(),
    trip(scene=None),
    trip(dropoff=None),
    trip(pickup=1300),
    trip(request=100, pickup=100, dropoff=100, ride=0),
    trip(dropoff=22_000),
    trip(pickup=7_300, dropoff=9_000),
    trip(miles=0.0),
    trip(miles=30.0),
    trip(pu=264),
]


def test_each_rule_fires_with_an_exact_count(spark):
    audit = {r["rule"]: (r["rows"], r["rejected"]) for r in cleaning.audit(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert audit == {
        "timestamps_present": (10, 1),
        "timestamps_ordered": (10, 2),
        "positive_duration": (10, 2),
        "duration_under_6h": (10, 2),
        "dispatch_under_2h": (10, 1),
        "distance_consistent": (10, 1),
        "speed_plausible": (10, 1),
        "zones_routable": (10, 1),
    }
    kept = cleaning.clean(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(kept) == 2
    assert [r["total_time_s"] for r in kept] == [1200, 1200]
    assert sorted(r["dispatch_approach_s"] is None for r in kept) == [False, True]


def test_nulls_reject_a_row(spark):
    empty = spark.createDataFrame([("HV0003", None, None, None, None, None, 1, 2, None, 5)], SCHEMA)
    audit = {r["rule"]: r["rejected"] for r in cleaning.audit(empty).collect()}
    assert audit["timestamps_present"] == audit["distance_consistent"] == audit["speed_plausible"] == 1
    assert audit["zones_routable"] == 0
    assert cleaning.apply_rules(empty).count() == 0


def test_monthly_total_adds_up(spark):
    rows = [trip(request=m * 31 * 86400, scene=None, pickup=m * 31 * 86400 + 60, dropoff=m * 31 * 86400 + 900) for m in (0, 0, 1)]
    report = {r["month"]: r["rows_in"] for r in cleaning.monthly_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert report == {"1970-01": 2, "1970-02": 1, "all": 3}


def test_clock_changes(spark):
    wall = [
        dt.datetime(2023, 11, 5, 1, 30),
        dt.datetime(2023, 3, 12, 2, 30),
        dt.datetime(2023, 7, 1, 12, 0),
        dt.datetime(2023, 1, 1, 12, 0),
    ]
    df = spark.createDataFrame([(w,) for w in wall], "w timestamp_ntz")
    instant = clock.instant_seconds(F.col("w"))
    got = df.select("w", instant.alias("i"), clock.local_seconds(instant).alias("l")).collect()
    offset = {r["w"]: None if r["i"] is None else (r["l"] - r["i"]) / 3600 for r in got}
    assert offset == {wall[0]: -4, wall[1]: None, wall[2]: -4, wall[3]: -5}


def test_raw_files_are_localised(spark, tmp_path):
    at = dt.datetime(2023, 7, 1, 12, 0)
    gap = dt.datetime(2023, 3, 12, 2, 30)
    rows = [("HV0003", at, None, at + dt.timedelta(minutes=5), at + dt.timedelta(minutes=20), 3, 9, 2.5, 900)]
    rows.append(("HV0005", gap, None, None, None, 3, 9, 2.5, 900))
    path = str(tmp_path / "raw")
    spark.createDataFrame(rows, trip_files.TRIP_SCHEMA).write.parquet(path)
    got = {r["operator"]: r for r in trip_files.read_trips(spark, path).collect()}
    assert got["HV0003"]["dropoff_s"] - got["HV0003"]["request_s"] == 1200
    assert got["HV0005"]["request_s"] is None and got["HV0005"]["request_local_s"] is None


def test_damaged_file_is_an_error(spark, tmp_path):
    path = tmp_path / "files"
    spark.range(1000).coalesce(1).write.parquet(str(path))
    victim = next(p for p in path.iterdir() if p.name.endswith(".parquet"))
    data = bytearray(victim.read_bytes())
    data[4:400] = b"\0" * 396
    victim.write_bytes(data)
    for extra in path.glob(".*.crc"):
        extra.write_bytes(b"")
    with pytest.raises(Exception):
        trip_files.file_check(spark, str(path), "id").collect()


def test_splits_are_half_open_days(spark):
    days = ["2022-12-31", "2023-01-01", "2023-09-30", "2023-10-01", "2023-11-15", "2023-12-15", "2024-01-15", "2024-03-11"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d string")
    late = df.withColumn("s", F.datediff(F.col("d").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + 84600)
    split = segments.split_of(F.col("s"), SplitConfig())
    got = late.select("i", split.alias("p"), segments.holdout_week(F.col("s"), split, SplitConfig()).alias("w"))
    rows = sorted((r["i"], r["p"], r["w"]) for r in got.collect())
    assert [r[1] for r in rows] == ["beyond", "train", "train", "cal", "val", "test", "holdout", "beyond"]
    assert [r[2] for r in rows] == [None] * 6 + [0, None]


def test_segment_edges(spark):
    cfg = SegmentConfig()
    hours = spark.range(24).withColumn("s", F.col("id") * 3600)
    got = [r[0] for r in hours.orderBy("id").select(segments.time_bucket(F.col("s"), cfg)).collect()]
    assert got == ["late_night"] * 5 + ["off_peak"] + ["peak_am"] * 4 + ["off_peak"] * 6 + ["peak_pm"] * 4 + ["off_peak"] * 3 + ["late_night"]
    miles = spark.createDataFrame([(None,), (1.9,), (2.0,), (8.0,), (8.1,)], "m double")
    assert [r[0] for r in miles.select(segments.trip_length_bucket(F.col("m"), cfg)).collect()] == [None, "short", "medium", "medium", "long"]
    sky = spark.createDataFrame([(0.0, 0.5), (0.1, 0.5), (-5.0, 0.2), (-5.0, None), (None, 0.9)], "t double, p double")
    assert [r[0] for r in sky.select(segments.weather_bucket(F.col("t"), F.col("p"), cfg)).collect()] == ["snow", "rain", "rain", "clear", "rain"]


def test_sampling_is_nested_and_independent_of_partitioning(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")

    def members(frame, tier):
        return {r["k"] for r in frame.filter(sampling.in_tier(sampling.key_hash(frame, ("k",)), tier)).collect()}

    tune, ablation = members(df, "tune"), members(df.repartition(13), "ablation")
    assert tune == members(df.repartition(5), "tune") and tune < ablation
    assert 450 < len(tune) < 750 and len(members(df, "full")) == 20_000
    with pytest.raises(ValueError):
        sampling.key_hash(df, ("missing",))


def test_missing_months(spark):
    rows = [(i, d * 86400) for i, d in enumerate((0, 60))]
    df = spark.createDataFrame(rows, "i int, request_local_s long")
    assert [r["month"] for r in trip_files.missing_months(df, "1970-01", "1970-04").orderBy("month").collect()] == ["1970-02", "1970-04"]
