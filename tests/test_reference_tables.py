import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripspark.operators import reference_tables as ref
from tripspark.sources.route_json import parse_route

TRIPS = """pu_zone long, do_zone long, request_local_s long, trip_miles double, trip_duration_s long, total_time_s long,
split string"""


def night(n, split="train", pu=1, do=2, miles=2.0, seconds=400, total=900):
    return [(pu, do, 3 * 3600, miles, seconds, total, split)] * n


def pairs(spark, rows=((1, 2, 1609.344, 100.0), (2, 1, 3000.0, 200.0))):
    return spark.createDataFrame(
        [(a, b, float(m), float(s), 1, 0.5, a == b, False) for a, b, m, s in rows],
        "pu_zone long, do_zone long, route_distance_m double, free_flow_duration_s double, turn_count int, "
        "highway_fraction double, is_intra_zone boolean, is_estimated boolean",
    )


def test_night_speed_needs_enough_trips(spark):
    for n, observed in ((200, True), (199, False)):
        history = ref.zone_history(spark.createDataFrame(night(n), TRIPS), pairs(spark))
        row = {r["zone_id"]: r for r in history.collect()}[1]
        assert row["reference_observed"] is observed and row["night_trips"] == n
        want = 2.0 * 1609.344 / 400 if observed else 16.09344
        assert row["reference_speed_ms"] == pytest.approx(want, rel=1e-6)
    assert {r["zone_id"] for r in history.collect()} == {1, 2}


def test_later_rows_move_no_artifact(spark):
    base = night(250) + [(1, 1, 9 * 3600, 0.5 + i * 0.01, 300, 500, "train") for i in range(40)]
    poison = [row for s in ("cal", "val", "test", "holdout", "beyond") for row in night(500, s, miles=90.0, seconds=70, total=9999)]
    zones = spark.createDataFrame([(1, 1.0), (2, 4.0)], "zone_id long, area_km2 double")
    clean_trips = spark.createDataFrame(base, TRIPS)
    dirty_trips = spark.createDataFrame(base + poison, TRIPS)

    def built(trips):
        return [
            sorted(map(tuple, ref.zone_history(trips, pairs(spark)).collect()), key=repr),
            sorted(map(tuple, ref.detour_ratios(trips, pairs(spark)).collect()), key=repr),
            sorted(map(tuple, ref.intra_zone_distances(trips, zones, 10).collect()), key=repr),
            sorted(map(tuple, ref.pair_counts(trips).collect())),
        ]

    assert built(clean_trips) == built(dirty_trips)


def test_detour_ratio_floor(spark):
    rows = night(40, miles=2.0) + night(5, pu=2, do=1) + night(90, "test", pu=2, do=1)
    got = {(r[0], r[1]): (r[2], r[3]) for r in ref.detour_ratios(spark.createDataFrame(rows, TRIPS), pairs(spark)).collect()}
    assert got == {(1, 2): (2.0, 40), (2, 1): (None, 5)}


def test_matrix_is_completed_and_checked(spark):
    routed = pairs(spark, ((1, 2, 1000.0, 100.0), (2, 1, 0.0, 0.0))).drop("is_estimated")
    intra = spark.createDataFrame([(1, 400.0, True), (2, 800.0, False)], "pu_zone long, distance_m double, from_observation boolean")
    full = ref.complete_matrix(routed, intra)
    got = {(r["pu_zone"], r["do_zone"]): r for r in full.collect()}
    assert got[(2, 1)]["route_distance_m"] == 600.0 and got[(2, 1)]["is_estimated"]
    assert got[(2, 1)]["free_flow_duration_s"] == 60.0
    assert got[(1, 1)]["free_flow_duration_s"] == 40.0 and not got[(1, 2)]["is_estimated"]
    ref.validate_matrix(full, 2)
    for broken in (
        full.filter("NOT (pu_zone = 1 AND do_zone = 2)"),
        full.unionByName(full.limit(1)),
        full.withColumn("route_distance_m", F.lit(0.0).cast("float")),
        full.withColumn("highway_fraction", F.lit(1.5).cast("float")),
    ):
        with pytest.raises(ValueError):
            ref.validate_matrix(broken, 2)


def test_zone_table_checks(spark):
    schema = "zone_id long, centroid_lat double, centroid_lon double"
    good = spark.createDataFrame([(1, 40.7, -74.0), (2, 40.8, -73.9)], schema)
    ref.validate_zones(good, (1,))
    for rows, required in (([], ()), ([(1, 42.0, -74.0)], ()), ([(1, 40.7, -74.0)] * 2, ()), ([(1, 40.7, -74.0)], (132,))):
        with pytest.raises(ValueError):
            ref.validate_zones(spark.createDataFrame(rows, schema), required)


def test_embeddings_equal_a_dense_decomposition(spark):
    rng = np.random.default_rng(0)
    n = 6
    counts = rng.integers(0, 40, (n, n))
    counts[2, :] = 0
    rows = [r for i in range(n) for j in range(n) for r in night(int(counts[i, j]), pu=i + 1, do=j + 1)]
    zones = spark.range(1, n + 1).withColumnRenamed("id", "zone_id")
    got = ref.zone_embeddings(spark.createDataFrame(rows, TRIPS), zones, 3).orderBy("zone_id").collect()
    mine = np.array([r["embedding"] for r in got])
    w = np.log1p(counts)
    u, s, _ = np.linalg.svd(np.hstack([w, w.T]), full_matrices=False)
    full = u[:, :3] * s[:3]
    want = full - full.mean(axis=0)
    np.testing.assert_allclose(mine @ mine.T, want @ want.T, rtol=1e-4, atol=1e-4)


STEP = {"distance": 500.0, "maneuver": {"type": "turn", "modifier": "left"}, "intersections": [{"classes": ["motorway"]}]}


@pytest.mark.parametrize(
    "payload, want",
    [
        ({"routes": []}, None),
        ({}, None),
        ({"routes": [{"distance": 1000, "duration": 90, "legs": [{"steps": [STEP]}]}]}, (1000.0, 90.0, 1, 0.5)),
        ({"routes": [{"distance": 100, "duration": 90, "legs": [{"steps": [STEP]}]}]}, (100.0, 90.0, 1, 1.0)),
        ({"routes": [{"distance": 0, "duration": 0, "legs": []}]}, (0.0, 0.0, 0, 0.0)),
        ({"routes": [{"distance": 1000, "duration": 9}]}, (1000.0, 9.0, 0, 0.0)),
        (
            {"routes": [{"distance": 1000, "duration": 9, "legs": [{}, {"steps": [
                {"distance": 5, "maneuver": {"type": "turn", "modifier": "straight"}},
                {"maneuver": {"type": "rotary"}, "intersections": [{}, {"classes": ["motorway"]}]},
                {"distance": 100, "maneuver": {"type": "depart"}, "intersections": [{"classes": ["toll"]}]},
            ]}]}]},
            (1000.0, 9.0, 1, 0.0),
        ),
    ],
)
def test_route_json(spark, payload, want):
    row = spark.createDataFrame([(json.dumps(payload),)], "j string").select(parse_route(F.col("j")).alias("r")).first()["r"]
    assert (None if row is None else tuple(row)) == want


def test_a_route_text_is_parsed_once(spark):
    """Four columns read the answer; the text must not be parsed for each of them and for each lambda inside."""
    texts = spark.createDataFrame([('{"routes": []}',), (None,), ("no json",)], "j string")
    route = texts.select(parse_route(F.col("j")).alias("r")).select("r.route_distance_m", "r.turn_count", "r.highway_fraction")
    plan = route._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert [tuple(r) for r in route.collect()] == [(None, None, None)] * 3
