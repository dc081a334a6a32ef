import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tripspark.operators import dataset, features as ft, parity, zone_state

SPAN = dt.datetime(1970, 1, 1)


def static(spark):
    zones = [(z, 0.0 if z == 3 else z * 0.5, z == 1, "Manhattan" if z < 3 else "Nowhere") for z in range(1, 5)]
    matrix = [(a, b, 1000.0 * abs(a - b) + 10, 100.0, a, 0.1, a == b, False) for a in range(1, 5) for b in range(1, 5) if (a, b) != (4, 4)]
    detour = [(a, b, None if (a + b) % 3 == 0 else 1.2, a * b) for a, b, *_ in matrix]
    emb = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])]
    history = [(1, 900.0, 6.0), (2, None, 0.0), (3, 800.0, 5.0)]
    return ft.StaticTables(
        zones=spark.createDataFrame(zones, "zone_id long, area_km2 double, is_airport boolean, borough string"),
        matrix=spark.createDataFrame(
            matrix,
            "pu_zone long, do_zone long, route_distance_m float, free_flow_duration_s float, turn_count int, "
            "highway_fraction float, is_intra_zone boolean, is_estimated boolean",
        ),
        detour=spark.createDataFrame(detour, "pu_zone long, do_zone long, structural_detour_ratio float, detour_trips long"),
        embeddings=spark.createDataFrame(emb, "zone_id long, embedding array<float>"),
        history=spark.createDataFrame(history, "zone_id long, hist_mean_duration_s float, reference_speed_ms float"),
    )


def requests(spark, *rows):
    schema = "id int, pu_zone long, do_zone long, request_s long, request_local_s long"
    base = spark.createDataFrame(
        [(i, p, d, int((t - SPAN).total_seconds()), int((t - SPAN).total_seconds())) for i, (p, d, t) in enumerate(rows)], schema
    )
    readings = {"temp_c": 3.0, "wind_ms": 1.0, "visibility_m": None, "precip_mm_h": 0.4, "snow_depth_cm": None}
    return base.withColumns({k: F.lit(v).cast("float") for k, v in readings.items()})


def state(spark):
    schema = "zone long, bucket_s long, completed long, distance_m double, duration_s long"
    at = int((dt.datetime(2024, 1, 15, 17, 0) - SPAN).total_seconds())
    return zone_state.rolling_state(spark.createDataFrame([(1, at, 3, 3000.0, 600), (2, at, 1, 0.0, 0)], schema))


WHEN = dt.datetime(2024, 1, 15, 17, 31)


def test_registry_shape(spark):
    registry = ft.default_registry()
    assert len(registry) == 44
    assert registry.counts() == {"route": 8, "temporal": 10, "congestion": 12, "zone": 8, "weather": 6}
    assert len(registry.live_keys()) == 14
    with pytest.raises(ValueError):
        registry.add("turn_count", "route", "int", F.lit(1))


@pytest.fixture(scope="module")
def rows(spark):
    asked = requests(spark, (1, 2, WHEN), (2, 1, WHEN), (4, 4, WHEN), (3, 1, dt.datetime(2023, 7, 8, 2, 0)))
    out = ft.feature_frame(asked, static(spark), state(spark), carry=["id"]).collect()
    return {r["id"]: r for r in out}


def test_values(rows):
    r = rows[0]
    assert r["zone_completed_trips_60m"] == 3.0 and r["zone_mean_trip_duration_60m"] == 200.0
    assert r["zone_speed_ratio_60m"] == pytest.approx(5.0 / 6.0) and r["zone_trip_density_60m"] == 6.0
    assert r["detour_confidence"] == pytest.approx(math.log1p(2)) and r["structural_detour_ratio"] is None
    assert r["zone_embedding_similarity"] == pytest.approx(1 / math.sqrt(2))
    assert (r["is_holiday"], r["is_weekend"], r["same_borough"], r["is_intra_zone"]) == (True, False, True, False)
    assert r["minute_of_day"] == 17 * 60 + 31 and r["days_since_epoch"] == 379
    assert r["hour_sin"] == pytest.approx(math.sin((17 + 31 / 60) * 2 * math.pi / 24), abs=1e-6)
    assert (r["dow_sin"], r["month_cos"]) == (0.0, 1.0)
    assert r["precip_x_peak"] == pytest.approx(0.4) and r["visibility_m"] is None


def test_guards_and_missing(rows):
    assert rows[1]["zone_speed_ratio_15m"] == 0.0, "no seconds and no speed divide by their floors"
    assert rows[2]["route_distance_m"] is None and rows[2]["detour_confidence"] == 0.0
    assert rows[2]["zone_embedding_similarity"] is None and rows[2]["pu_hist_mean_duration_s"] is None
    assert rows[3]["zone_embedding_similarity"] is None, "a zero vector has no direction"
    assert rows[3]["zone_completed_trips_60m"] is None and rows[3]["is_weekend"]
    assert rows[3]["same_borough"] is False and rows[3]["precip_x_peak"] == 0.0


def test_features_cannot_read_the_outcome(spark):
    asked = requests(spark, (1, 2, WHEN)).withColumn("trip_miles", F.lit(3.0))
    assembled = ft.assemble(asked, static(spark), state(spark))
    ft.check_no_leakage(assembled, ft.default_registry())
    leaky = ft.default_registry()
    leaky.add("cheat", "route", "float", F.col("trip_miles") * 2)
    with pytest.raises(ValueError):
        ft.check_no_leakage(assembled, leaky)


def test_parity_catches_a_planted_difference(spark):
    asked = requests(spark, (1, 2, WHEN), (2, 1, WHEN), (4, 4, WHEN))
    registry = ft.default_registry()
    left = ft.feature_frame(asked, static(spark), state(spark), ["id"])
    assert parity.is_clean(parity.check_parity(left, left, "id", registry.names))
    for name, change in (
        ("temp_c", F.col("temp_c") * 1.001),
        ("turn_count", F.col("turn_count") + 1),
        ("is_intra_zone", ~F.col("is_intra_zone")),
        ("structural_detour_ratio", F.lit(0.0).cast("float")),
    ):
        report = parity.check_parity(left, left.withColumn(name, change), "id", registry.names)
        assert {r["feature"] for r in report.filter("mismatches > 0").collect()} == {name}
    tiny = parity.check_parity(left, left.withColumn("minute_of_day", F.col("minute_of_day") * 1.000001), "id", registry.names)
    assert parity.is_clean(tiny)
    nan = left.withColumn("visibility_m", F.lit(float("nan")).cast("float"))
    assert parity.is_clean(parity.check_parity(left, nan, "id", registry.names)), "null and NaN are both missing"
    short = parity.check_parity(left, left.filter("id > 0"), "id", ["temp_c"]).first()
    assert (short["rows"], short["mismatches"]) == (3, 1)


def test_population_digest(spark):
    df = spark.range(500).select(
        (F.col("id") * 7).alias("request_s"), (F.col("id") % 9).alias("pu_zone"), (F.col("id") % 5).alias("do_zone")
    )
    one = dataset.population_digest(df).first()
    assert one == dataset.population_digest(df.repartition(6).orderBy(F.desc("request_s"))).first()
    assert one["digest"] != dataset.population_digest(df.filter("request_s > 0")).first()["digest"]
    swapped = df.select("request_s", F.col("pu_zone").alias("pu_zone"), F.col("do_zone").alias("x")).withColumn(
        "do_zone", F.when(F.col("request_s") == 0, F.lit(1)).when(F.col("request_s") == 7, F.lit(0)).otherwise(F.col("x"))
    )
    assert one["digest"] != dataset.population_digest(swapped).first()["digest"], "equal sums, other rows"


def test_trips_meet_the_state_only_where_a_feature_reads_it(spark, sf_dir):
    from tripspark.plans import catalog

    registry = ft.default_registry()
    assert {f.family for f in registry.pick() if f.reads_zone_state} == {"congestion"}
    assert all(f.reads_zone_state for f in registry.family("congestion"))

    def plan(name):
        return catalog.load()[name].run(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()

    assert "Window" in plan("congestion_features")
    for name in ("embedding_similarity_feature", "zone_features", "route_features", "temporal_features", "weather_features"):
        assert "Window" not in plan(name)


def test_trips_are_not_shuffled_for_lookups(spark, sf_dir):
    from tripspark.plans import catalog

    for name in ("embedding_similarity_feature", "zone_features"):
        plan = catalog.load()[name].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_matrix_is_written_from_where_its_rows_are(spark, tmp_path):
    """A folder per split without a shuffle of the whole matrix: every task writes its own rows of a split."""
    from pathlib import Path

    split = F.when(F.col("id") % 10 == 0, "val").otherwise("train").alias("split")
    matrix = spark.range(0, 4000, 1, 4).select(F.col("id").alias("trip_id"), split)
    dataset.write_model_matrix(matrix, path := str(tmp_path / "matrix"))
    assert len(list(Path(path, "split=train").glob("*.parquet"))) == 4
    found = {s: {r["trip_id"] for r in dataset.load_split(spark, path, s).collect()} for s in ("train", "val")}
    assert found["val"] == set(range(0, 4000, 10)) and found["train"] == set(range(4000)) - found["val"]
