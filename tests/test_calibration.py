import numpy as np
import pytest
from pyspark.sql import functions as F

from tripspark.operators import calibration as cb

AXES = ("seg_time", "seg_zone_density", "seg_weather")


def cells(spark, *groups):
    """(time, density, weather, rows) groups with scores spread evenly."""
    frames = [
        spark.range(n).select(
            F.lit(t).cast("string").alias("seg_time"), F.lit(z).alias("seg_zone_density"), F.lit(w).alias("seg_weather"),
            F.col("id").alias("trip_id"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), (F.col("id") + 1).cast("double").alias("actual"),
        )
        for t, z, w, n in groups
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def test_conformal_order_statistic(spark):
    for n, risk, want in ((100, 0.1, 91.0), (5, 0.01, 5.0), (9, 0.1, 9.0)):
        row = cb.split_conformal(cells(spark, ("peak_am", "airport", "clear", n)), risk).first()
        assert (row["q_s"], row["n"]) == (want, n)


def test_thin_cells_borrow_from_the_nearest_margin(spark):
    frame = cells(spark, ("peak_am", "airport", "clear", 20000), ("peak_pm", "airport", "clear", 6000), ("peak_pm", "airport", "snow", 50))
    plan = {(r["seg_time"], r["seg_weather"]): r for r in cb.cell_plan(frame, AXES, 5000).collect()}
    assert plan[("peak_am", "clear")]["gid"] == 0 and plan[("peak_pm", "clear")]["gid"] == 0
    thin = plan[("peak_pm", "snow")]
    assert (thin["cell_rows"], thin["n"], thin["gid"]) == (50, 6050, 1), "weather is dropped, time and density stay"
    summary = cb.plan_summary(cb.cell_plan(frame, AXES, 5000), 3).first()
    assert tuple(summary) == (3, 2, 1, 0)


def test_ties_go_in_axis_order_and_nothing_falls_to_everything(spark):
    frame = cells(spark, ("peak_am", "airport", "clear", 10), ("peak_am", "airport", "rain", 10), ("peak_am", "outer_borough", "clear", 10))
    plan = {(r["seg_zone_density"], r["seg_weather"]): r["gid"] for r in cb.cell_plan(frame, AXES, 20).collect()}
    assert plan[("airport", "clear")] == 1, "dropping the last axis comes before dropping the middle one"
    assert {r["gid"] for r in cb.cell_plan(frame, AXES, 31).collect()} == {7}


def test_a_null_bucket_is_its_own_cell(spark):
    frame = cells(spark, (None, "airport", "clear", 30), ("peak_am", "airport", "clear", 40))
    plan = {r["seg_time"]: (r["gid"], r["n"]) for r in cb.cell_plan(frame, AXES, 20).collect()}
    assert plan == {None: (0, 30), "peak_am": (0, 40)}
    fitted = {r["seg_time"]: r["q_s"] for r in cb.mondrian_conformal(frame, 0.1, AXES, 20).collect()}
    assert fitted == {None: 28.0, "peak_am": 37.0}


def test_cell_widths_reach_the_target_in_every_cell(spark):
    rng = np.random.default_rng(4)

    def sample(n):
        time = rng.choice(["peak_am", "off_peak"], n, p=[0.1, 0.9])
        spread = np.where(time == "peak_am", 300.0, 50.0)
        y = 1000 + rng.normal(0, 1, n) * spread
        return spark.createDataFrame(
            [(t, "airport", "clear", 950.0, 1050.0, float(v)) for t, v in zip(time.tolist(), y)],
            "seg_time string, seg_zone_density string, seg_weather string, lo double, hi double, actual double",
        )

    cal, test = sample(12000), sample(8000)
    overall = cb.split_conformal(cal, 0.1)
    fitted = cb.mondrian_conformal(cal, 0.1, AXES, 500)
    marginal, conditional = cb.apply_split(test, overall), cb.apply_mondrian(test, fitted, overall, AXES)

    def cover(frame):
        out = cb.interval_coverage(frame, 0.9, ["seg_time"], min_rows=100).collect()
        return {r["bucket"]: r["empirical"] for r in out}

    assert cover(marginal)["all"] == pytest.approx(0.9, abs=0.015) and cover(marginal)["peak_am"] < 0.75
    assert all(v == pytest.approx(0.9, abs=0.03) for v in cover(conditional).values())


def test_unseen_cell_takes_the_overall_width(spark):
    cal = cells(spark, ("peak_am", "airport", "clear", 100))
    test = cells(spark, ("off_peak", "airport", "rain", 1))
    overall = cb.split_conformal(cal, 0.1)
    row = cb.apply_mondrian(test, cb.mondrian_conformal(cal, 0.1, AXES, 10), overall, AXES).first()
    assert (row["lo"], row["hi"]) == (-91.0, 91.0)


def test_increasing_fit_and_interpolation(spark):
    y = [1.0, 5.0, 3.0, 4.0, 9.0, 2.0, 12.0]
    points = [{"x": float(i), "y": v, "w": 1.0} for i, v in enumerate(y)]
    df = spark.createDataFrame([(points,)], "points array<struct<x:double,y:double,w:double>>")
    ys = cb._pool_adjacent(df).first()["ys"]
    np.testing.assert_allclose(ys, [1.0, 4.0, 4.0, 4.0, 5.5, 5.5, 12.0])
    grid = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 5.5, 6.0, 99.0, None)], "v double")
    xs, line = F.array(*[F.lit(float(i)) for i in range(7)]), F.array(*[F.lit(v) for v in ys])
    got = [r[0] for r in grid.select(cb.interpolate(xs, line, F.col("v"))).collect()]
    assert got[-1] is None
    np.testing.assert_allclose(got[:-1], [1.0, 1.0, 2.5, 8.75, 12.0, 12.0])


def test_isotonic_repairs_a_biased_bucket_and_thin_ones_use_the_whole(spark):
    rng = np.random.default_rng(8)
    n = 6000
    bucket = rng.choice(["airport", "outer_borough"], n, p=[0.95, 0.05])
    pred = rng.uniform(500, 2000, n)
    actual = pred + rng.normal(0, 100, n) + np.where(bucket == "airport", 200, 0)
    df = spark.createDataFrame(
        [(i, b, [float(p)], float(a)) for i, (b, p, a) in enumerate(zip(bucket.tolist(), pred, actual))],
        "trip_id long, seg_zone_density string, q array<double>, actual double",
    )
    maps = cb.fit_isotonic(df, (0.75,), ["seg_zone_density"], 5000)
    assert {r["bucket"] for r in maps.collect()} == {"*", "airport"}
    fixed = cb.apply_isotonic(df, maps, (0.75,), "seg_zone_density")
    rows = {r["bucket"]: r["empirical"] for r in cb.coverage_report(fixed, (0.75,), ["seg_zone_density"], min_rows=100).collect()}
    assert rows["airport"] == pytest.approx(0.75, abs=0.01)
    raw = cb.coverage_report(df, (0.75,), ["seg_zone_density"], min_rows=100)
    assert {r["bucket"]: r["empirical"] for r in raw.collect()}["airport"] < 0.1
    assert cb.worst_segment(raw).first()["worst_segment"] == "seg_zone_density=airport"


def test_large_maps_are_the_small_ones(spark):
    """The job of one task per map and the one from counts give the same maps, ties, nulls and thin bins included."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(6000):
        p = float(rng.integers(0, 40)) * 25
        bucket = ["a", "b", None][int(rng.integers(0, 3))] if i % 50 else "thin"
        actual = None if i % 97 == 0 else p + float(rng.normal(0, 60))
        rows.append((i % 2, i, actual, [p, None if i % 31 == 0 else p + 30.0], bucket))
    df = spark.createDataFrame(rows, "seed int, trip_id long, actual double, q array<double>, seg_zone_density string")
    def maps(most):
        found = cb.fit_isotonic(df, (0.5, 0.9), ["seg_zone_density"], 300, keys=["seed"], most=most)
        return {(r["seed"], r["bucket"], r["level"]): r for r in found.collect()}
    one, two = maps(1_000_000), maps(0)
    assert one.keys() == two.keys() and len(one) == 12
    for key in one:
        assert one[key]["rows"] == two[key]["rows"]
        np.testing.assert_allclose(one[key]["xs"], two[key]["xs"])
        np.testing.assert_allclose(one[key]["ys"], two[key]["ys"])


def test_pools_are_the_largest_of_smallest_means(spark):
    rng = np.random.default_rng(3)
    for _ in range(20):
        y, w = rng.normal(0, 1, 12).round(1), rng.integers(1, 4, 12)
        want = [
            max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 12)) for a in range(i + 1))
            for i in range(12)
        ]
        np.testing.assert_allclose(cb.pool_adjacent(y, w), want)
