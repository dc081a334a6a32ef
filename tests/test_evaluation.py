import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripspark.config import CostConfig
from tripspark.functions import scores, vectors
from tripspark.operators import evaluation as ev

COST = CostConfig()


def test_cost_is_three_to_one(spark):
    df = spark.createDataFrame([(100.0, 90.0), (90.0, 100.0), (50.0, 50.0), (None, 1.0)], "a double, p double")
    got = [tuple(r) for r in df.select(scores.business_cost(F.col("a"), F.col("p"), COST), scores.is_late(F.col("a"), F.col("p"))).collect()]
    assert got == [(30.0, True), (10.0, False), (0.0, False), (None, None)]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(600.0, 700.0), (900.0, 800.0), (1200.0, 1200.0), (1500.0, 1400.0)], "actual double, promised double")
    row = df.agg(*ev.metrics(COST)).first()
    assert (row["business_cost"], row["mae"], row["late_rate"]) == (175.0, 75.0, 0.5)
    assert row["rmse"] == pytest.approx(np.sqrt(7500)) and 4 * row["pinball_at_q_star"] == pytest.approx(row["business_cost"])


def test_segments_need_rows_and_null_is_no_bucket(spark):
    rows = [("a", 10.0, 9.0)] * 1000 + [("b", 10.0, 9.0)] * 999 + [(None, 10.0, 9.0)] * 1000
    out = ev.evaluate(spark.createDataFrame(rows, "seg string, actual double, promised double"), COST, ["seg"])
    assert {(r["axis"], r["bucket"], r["rows"]) for r in out.collect()} == {("global", "all", 2999), ("seg", "a", 1000)}


def test_leaderboard_refuses_mixed_populations(spark):
    schema = "model string, seed int, rows long, business_cost double, mae double, rmse double, late_rate double, pinball_at_q_star double, population string"
    rows = [("x", s, 9, 10.0 + s, 1.0, 1.0, 0.1, 1.0, "p") for s in range(3)] + [("y", 0, 9, 22.0, 1.0, 1.0, 0.1, 1.0, "p")]
    summary = ev.leaderboard(ev.summarise_seeds(spark.createDataFrame(rows, schema)), "y").collect()
    assert [(r["model"], r["business_cost_mean"], r["business_cost_std"], r["vs_baseline_pct"]) for r in summary] == [
        ("x", 11.0, 1.0, -50.0), ("y", 22.0, 0.0, 0.0)
    ]
    with pytest.raises(ValueError):
        ev.summarise_seeds(spark.createDataFrame([*rows, ("z", 0, 9, 1.0, 1.0, 1.0, 0.1, 1.0, "q")], schema))


def test_champion_is_the_lowest_mean(spark):
    rows = [("a", 10.0), ("a", 14.0), ("b", 11.0), ("b", 11.2), ("c", 30.0)]
    row = ev.select_champion(spark.createDataFrame(rows, "model string, val_cost double")).first()
    assert row["champion"] == "b" and row["margin"] == pytest.approx(0.9) and row["margin_exceeds_seed_spread"]
    assert ev.select_champion(spark.createDataFrame([("a", 1.0)], "model string, val_cost double")).first()["margin"] == 0.0


def test_crossing_by_hand(spark):
    q = [[1.0, 2.0, 3.0], [200.0, 100.0, 150.0], [1.0, 5.0, 4.0], [9.0, 7.0, 6.0]]
    df = spark.createDataFrame([(x,) for x in q], "q array<double>")
    row = ev.crossing_report(df, (0.5, 0.75, 0.9)).first()
    assert (row["rows"], row["crossing_rows"], row["P50_over_P75"], row["P75_over_P90"]) == (4, 3, 0.5, 0.5)
    assert row["worst_gap_s"] == 100.0 and row["mean_gap_s"] == pytest.approx((100 + 1 + 2 + 1) / 4)
    fixed = [r[0] for r in df.select(vectors.running_max(F.col("q"))).collect()]
    assert fixed == [np.maximum.accumulate(x).tolist() for x in q]
    clean = ev.crossing_report(df.withColumn("q", vectors.sort_row(F.col("q"))), (0.5, 0.75, 0.9)).first()
    assert clean["crossing_rows"] == 0 and clean["worst_gap_s"] == 0.0 and clean["mean_gap_s"] == 0.0
    with pytest.raises(ValueError):
        ev.crossing_report(df, (0.9, 0.5))


def test_clamped_steps(spark):
    df = spark.createDataFrame([([5.0, 2.0, -3.0, 1.0],), ([-4.0, 1.0, 1.0, 1.0],)], "steps array<double>")
    assert [r[0] for r in df.select(ev.clamp_steps(F.col("steps"))).collect()] == [[5.0, 7.0, 7.0, 8.0], [-4.0, -3.0, -2.0, -1.0]]


def test_ordered_heads(spark):
    row = spark.createDataFrame([(3.0, [0.0, 800.0, -800.0])], "b double, r array<double>").select(
        vectors.ordered_heads(F.col("b"), F.col("r"))
    ).first()[0]
    np.testing.assert_allclose(row, [3.0, 3 + np.log(2), 803 + np.log(2), 803 + np.log(2)])


def test_paired_days(spark):
    diffs = [-30.0, -5.0, 4.0, 0.0, 30.0, -1.0, -2.0, -3.0, -4.0, -6.0]
    day0 = (dt.date(2024, 1, 1) - dt.date(1970, 1, 1)).days
    # An early promise costs its distance, so the difference is set by the promise.
    rows = [((day0 + i) * 86400 + 50, 0.0, 100.0 + x, 100.0) for i, x in enumerate(diffs)]
    row = ev.paired_blocks(spark.createDataFrame(rows, "request_local_s long, actual double, promised double, baseline double"), COST).first()
    assert (row["blocks"], row["champion_wins"], row["longest_losing_streak"]) == (10, 7, 3)
    assert (row["best_block_diff"], row["worst_block_diff"]) == (-30.0, 30.0)
    assert row["p10_diff"] == pytest.approx(np.percentile(diffs, 10)) and row["weekend_diff"] == pytest.approx(-1.5)


def test_windows_hold_equally_many_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(40) * 1000, float(rng.randrange(900)), 500.0, 450.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "trip_id long, request_s long, actual double, promised double, baseline double")
    got = {r["window"]: r for r in ev.temporal_windows(df.repartition(5), COST).collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for name, lo, hi in (("early", 0, 333), ("middle", 333, 666), ("late", 666, 1000)):
        part = ordered[lo:hi]
        assert got[name]["rows"] == hi - lo
        want = np.mean([3 * max(a - p, 0) + max(p - a, 0) for _, _, a, p, _ in part])
        assert got[name]["champion_cost"] == pytest.approx(want)
