"""Raw files of several layouts, damaged and empty ones; exact samples; tables of settings."""

import pytest
from pyspark.sql import functions as F

from tripspark.config import CostConfig, ModelConfig, Settings, check_settings
from tripspark.functions import sampling
from tripspark.operators import ingest
from tripspark.sources import trip_files

RAW = (
    "hvfhs_license_num string, request_datetime timestamp_ntz, on_scene_datetime timestamp_ntz, pickup_datetime timestamp_ntz, "
    "dropoff_datetime timestamp_ntz, PULocationID long, DOLocationID long, trip_miles double, trip_time long"
)


def raw(spark, times):
    rows = [("HV0003", t, t, t, t, 3, 4, 1.5, 600) for t in times]
    text = RAW.replace("timestamp_ntz", "string")
    frame = spark.createDataFrame(rows, text)
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in frame.columns if c.endswith("_datetime")})


def test_each_file_has_an_outcome_and_damaged_ones_add_no_row(spark, tmp_path):
    good = raw(spark, ["2024-03-10 01:30:00", "2024-03-10 02:30:00", "2024-11-03 01:30:00"])
    good.coalesce(1).write.parquet(str(tmp_path / "m=1"))
    old = good.drop("on_scene_datetime").withColumns({"PULocationID": F.col("PULocationID").cast("int"), "trip_miles": F.col("trip_miles").cast("float")})
    old.coalesce(1).write.parquet(str(tmp_path / "m=2"))
    good.limit(0).coalesce(1).write.parquet(str(tmp_path / "m=3"))
    good.coalesce(1).write.parquet(str(tmp_path / "m=4"))
    for file in (tmp_path / "m=4").glob("*.parquet"):
        # Cut off in the middle, as a download that broke.
        file.write_bytes(file.read_bytes()[:-200])
    for crc in (tmp_path / "m=4").glob(".*.crc"):
        crc.unlink()
    (tmp_path / "m=1" / "_notes.txt").write_text("no data")
    done = ingest.ingest(spark, f"{tmp_path}/m=*/*")
    got = {r["file"].split("m=")[1][0]: (r["status"], r["rows"], r["gap_nulls"], r["lacking"]) for r in done.outcomes.collect()}
    assert got == {
        "1": ("read", 3, 4, []),
        "2": ("read", 3, 3, ["on_scene_datetime"]),
        "3": ("empty", 0, 0, []),
        "4": ("damaged", 0, 0, []),
    }
    trips = done.trips.collect()
    assert len(trips) == 6 and sum(t["request_s"] is None for t in trips) == 2
    # The hour that comes twice is the earlier instant, four hours behind UTC.
    assert {t["request_s"] - t["request_local_s"] for t in trips if t["request_s"]} == {5 * 3600, 4 * 3600}
    report = {r["month"]: r["rows_in"] for r in done.report().collect()}
    assert report == {"2024-03": 2, "2024-11": 2, "unknown": 2, "all": 6}


def test_files_that_do_not_open_cost_no_second_decoding(spark, tmp_path, monkeypatch):
    for k in range(3):
        raw(spark, ["2024-03-10 01:30:00"]).coalesce(1).write.parquet(str(tmp_path / f"m={k}"))
    (tmp_path / "m=3").mkdir()
    (tmp_path / "m=3" / "x.parquet").write_text("a download that broke off")
    decoded, measured = [], ingest._measured
    monkeypatch.setattr(ingest, "_measured", lambda spark, files, tz: decoded.extend(files) or measured(spark, files, tz))
    files = ingest.list_files(spark, f"{tmp_path}/m=*/*")
    got = sorted((r["status"], r["rows"]) for r in ingest.file_outcomes(spark, files).collect())
    assert got == [("damaged", 0)] + 3 * [("read", 1)]
    assert sorted(decoded) == files[:3]


def test_a_time_is_converted_once_and_back_once(spark, tmp_path):
    raw(spark, ["2024-03-10 01:30:00"]).write.parquet(str(tmp_path / "m"))
    frame = spark.read.schema(RAW).parquet(str(tmp_path / "m"))
    for used in (trip_files.localise(frame), ingest._measured(spark, [str(tmp_path / "m")], "America/New_York")):
        plan = used._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.lower().count("convert_timezone") <= 8


def test_no_files_and_no_sound_files_are_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ingest.ingest(spark, f"{tmp_path}/*")
    (tmp_path / "x.parquet").write_text("nothing")
    with pytest.raises(ValueError):
        ingest.ingest(spark, f"{tmp_path}/*")


def test_exact_samples(spark):
    frame = spark.range(5000).select(F.col("id"), (F.col("id") % 7).alias("k"), F.lit("x").alias("_place"))
    wanted = sampling.sample_of_size(frame, ["id"], 300)
    one = sorted(r["id"] for r in wanted.collect())
    two = sorted(r["id"] for r in sampling.sample_of_size(frame.repartition(13, "k"), ["id"], 300).collect())
    assert one == two and len(one) == len(set(one)) == 300
    other = sorted(r["id"] for r in sampling.sample_of_size(frame, ["id"], 300, seed=1).collect())
    assert other != one
    # All rows share seven hashes here, and the size still holds.
    assert sampling.sample_of_size(frame.drop("_place"), ["k"], 300).count() == 300
    assert sampling.sample_of_size(frame, ["id"], 9000).count() == 5000
    assert sampling.sample_of_size(frame, ["id"], 0).count() == 0
    assert sampling.sample_of_size(frame.limit(0), ["id"], 5).count() == 0
    with pytest.raises(ValueError):
        sampling.sample_of_size(frame, ["id"], -1)


def test_tables_of_settings_agree_with_the_checked_class(spark):
    rows = [
        (3.0, 1.0, [0.05, 0.5, 0.75, 0.9, 0.95], 0.9, [0, 1, 2]),
        (2.0, 1.0, [0.05, 0.5, 0.75, 0.9, 0.95], 0.9, [0, 1, 2]),
        (3.0, 1.0, [0.05, 0.75, 0.5, 0.9, 0.95], 0.9, [0, 1]),
        (3.0, 1.0, [0.1, 0.5, 0.75, 0.9], 0.9, [0, 1, 2]),
        (0.0, 1.0, [0.05, 0.5, 0.75, 1.0, 0.95], None, [0, 0, 0]),
        (3.0, 1.0, [0.75], 0.9, None),
        (3.0, 1.0, [], 0.9, [0, 1, 2]),
    ]
    frame = spark.createDataFrame(rows, "lambda_late double, lambda_early double, levels array<double>, coverage double, seeds array<int>")
    got = [(r["serves"], r["brackets"], r["ascends"], r["enough_seeds"]) for r in check_settings(frame).collect()]
    assert got == [
        (True, True, True, True), (False, True, True, True), (True, True, False, False), (True, False, True, True),
        (False, False, False, False), (True, False, True, False), (False, False, False, True),
    ]
    for (late, early, levels, _, seeds), flags in zip(rows[:4], got, strict=False):
        try:
            Settings(cost=CostConfig(late, early), model=ModelConfig(tuple(levels), (0.5,), tuple(seeds)))
            assert all(flags)
        except ValueError:
            assert not all(flags)
