import numpy as np
from hypothesis import HealthCheck, given, settings as hsettings, strategies as st
from pyspark.sql import functions as F

from tripspark.operators.orderstats import Quantile, group_quantiles, row_edges, slice_of


def frame(spark, groups, values):
    return spark.createDataFrame(list(zip(groups, values)), "g string, v double")


def test_linear_quantiles_equal_numpy_on_a_skewed_group(spark):
    rng = np.random.default_rng(1)
    groups = np.where(rng.random(6000) < 0.9, "hot", "cold")
    values = np.round(rng.normal(0, 300, 6000), 2)
    df = frame(spark, groups.tolist(), values.tolist()).repartition(7)
    wanted = {"a": Quantile(0.5), "b": Quantile(0.9), "c": Quantile(0.0), "d": Quantile(1.0)}
    for most in (3, 200, 100_000):
        got = {r["g"]: r for r in group_quantiles(df, ["g"], "v", wanted, most=most).collect()}
        for g in ("hot", "cold"):
            own = values[groups == g]
            assert got[g]["n"] == own.size
            np.testing.assert_allclose(
                [got[g][k] for k in "abcd"], np.quantile(own, [0.5, 0.9, 0.0, 1.0]), rtol=0, atol=1e-9
            )


@hsettings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e4, 1e4, allow_nan=False), min_size=1, max_size=30), st.sampled_from([0.05, 0.1, 0.5]))
def test_conformal_rank(spark, values, risk):
    df = frame(spark, ["x"] * len(values), [float(v) for v in values])
    got = group_quantiles(df, ["g"], "v", {"q": Quantile(risk, "conformal")}).first()["q"]
    rank = min(int(np.ceil((len(values) + 1) * (1 - risk))), len(values))
    assert got == sorted(values)[rank - 1]


def test_null_groups_null_values_and_no_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("a", 5.0)], "g string, v double")
    got = {r["g"]: (r["n"], r["q"]) for r in group_quantiles(df, ["g"], "v", {"q": Quantile(0.5)}).collect()}
    assert got == {None: (2, 2.0), "a": (1, 5.0)}
    assert group_quantiles(df, [], "v", {"q": Quantile(0.5)}).first()["q"] == 3.0


def test_equal_count_slices_split_ties(spark):
    n, parts = 1003, 7
    df = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") % 3).cast("double").alias("v"), "id")
    edges = row_edges(df, ["g"], "v", "id", lambda _n: F.lit(parts))
    sliced = df.join(edges, "g").select("v", "id", slice_of(F.col("edges"), F.col("v"), F.col("id"), parts).alias("s"))
    rows = sorted((r["v"], r["id"], r["s"]) for r in sliced.collect())
    bounds = [i * n // parts for i in range(parts + 1)]
    assert [r[2] for r in rows] == [s for s in range(parts) for _ in range(bounds[s + 1] - bounds[s])]


def test_no_task_ranks_more_than_a_small_part_of_one_large_group(spark, monkeypatch):
    """Continuous values, one group: what reaches the last ranking is bounded, whatever the number of rows."""
    from tripspark.operators import orderstats

    ranked = []
    inside = orderstats._inside

    def counted(rows, ranges, keys):
        out = inside(rows, ranges, keys)
        ranked.append(out.count())
        return out

    monkeypatch.setattr(orderstats, "_inside", counted)
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=40_000), [1e12, -1e12], np.full(5000, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(8)
    wanted = {"a": Quantile(0.1), "b": Quantile(0.5), "c": Quantile(0.99)}
    got = group_quantiles(df, [], "v", wanted, most=500).first()
    np.testing.assert_allclose([got[k] for k in "abc"], np.quantile(values, [0.1, 0.5, 0.99]), atol=1e-12)
    assert ranked[0] == len(values) and ranked[-1] <= 6 * 500 + 5000


def test_values_at_the_ends_of_the_number_line(spark):
    values = [-1.7e308, 1.7e308, 0.0, 5e-324, 1.0, float("inf"), -float("inf"), 2.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for q, want in ((0.0, -float("inf")), (0.5, 1.0), (1.0, float("inf"))):
        assert group_quantiles(df, [], "v", {"q": Quantile(q, "nearest")}, most=2).first()["q"] == want
