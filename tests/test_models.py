import numpy as np
import pytest
from pyspark.sql import functions as F

from tripspark.functions import scores, vectors
from tripspark.operators import baselines, boosting as bt
from tripspark.sources import artifacts
from tripspark.vocab import TARGET

PARAMS = bt.BoostParams(rounds=12, rate=0.5, leaves=8, depth=3, min_rows=20, patience=4)
FEATURES = ("f1", "f2")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)

    def sample(n, base):
        x1, x2 = rng.uniform(0, 1, n), rng.uniform(0, 1, n)
        y = 600 + 900 * x1 + rng.normal(0, 1, n) * (60 + 300 * x2)
        rows = [(base + i, float(a), None if b < 0.02 else float(b), float(c)) for i, (a, b, c) in enumerate(zip(x1, x2, y))]
        return spark.createDataFrame(rows, f"trip_id long, f1 double, f2 double, {TARGET} double").cache()

    return sample(4000, 0), sample(1500, 10_000), sample(1500, 20_000)


@pytest.fixture(scope="module")
def rows(data):
    return bt.prepare(data[0], data[1], FEATURES, "trip_id")


def mean_loss(frame, prediction, level):
    return frame.agg(F.avg(scores.pinball(F.col(TARGET), prediction, level))).first()[0]


def test_models_reach_their_level_and_stop_early(spark, data, rows):
    tasks = bt.bundle_tasks((0.5, 0.9), bt.BoostParams(rate=0.3, leaves=8, depth=3, min_rows=20, patience=3))
    models = bt.fit(rows, tasks)
    for task in tasks:
        model = models[task.name]
        assert model.stopped == "early" and len(model.trees) == model.losses.index(min(model.losses))
        scored = data[2].withColumn("q", bt.predictions(spark, [model])[0])
        assert scored.agg(F.avg((F.col(TARGET) <= F.col("q")).cast("int"))).first()[0] == pytest.approx(task.level, abs=0.05)
        assert mean_loss(scored, F.col("q"), task.level) < 0.8 * mean_loss(scored, F.lit(model.start), task.level)
        # What the passes added up on validation rows is what the kept trees predict there.
        checked = data[1].withColumn("q", bt.predictions(spark, [model])[0])
        assert mean_loss(checked, F.col("q"), task.level) == pytest.approx(min(model.losses), rel=1e-9)


def test_first_split_is_the_best_one(spark, data, rows):
    """Against all thresholds of all features, tried one by one."""
    model = bt.fit(rows, [bt.Task("one", 0.75, bt.BoostParams(rounds=1, leaves=2, depth=1, min_rows=20))])["one"]
    if not model.trees:
        pytest.fail("one round must beat the constant")
    train = data[0].toPandas()
    y, start = train[TARGET].to_numpy(), model.start
    assert start == pytest.approx(np.quantile(y, 0.75))
    grad = np.where(y > start, -0.75, 0.25)
    best = (-1.0, None, None)
    for j, name in enumerate(FEATURES):
        x = train[name].to_numpy()
        for edge in rows.edges[j]:
            left = ~(x > edge)
            if min(left.sum(), (~left).sum()) >= 20:
                gain = grad[left].sum() ** 2 / left.sum() + grad[~left].sum() ** 2 / (~left).sum()
                best = max(best, (gain, j, edge), key=lambda b: b[0])
    tree = model.trees[0]
    assert (tree.feature[0], tree.threshold[0]) == (best[1], best[2])
    left = ~(train[FEATURES[best[1]]].to_numpy() > best[2])
    for side, node in ((left, tree.left[0]), (~left, tree.right[0])):
        assert tree.rows[node] == side.sum()
        want = np.quantile(y[side] - start, 0.75)
        assert tree.value[node] == pytest.approx(0.3 * want, abs=0.3 * (0.02 * abs(want) + 5))


def test_lockstep_changes_nothing(rows):
    alone = bt.fit(rows, [bt.Task("a", 0.75, PARAMS)])["a"]
    both = bt.fit(rows, [bt.Task("b", 0.5, PARAMS), bt.Task("a", 0.75, PARAMS)])["a"]
    assert alone.losses == both.losses and len(alone.trees) == len(both.trees)
    for s, t in zip(alone.trees, both.trees, strict=True):
        assert (s.feature == t.feature).all() and (s.value == t.value).all()


def test_shares_of_rows_and_columns(rows):
    half = bt.BoostParams(rounds=3, leaves=8, depth=3, min_rows=20, row_share=0.5, column_share=0.5, seed=4)
    task = bt.Task("half", 0.5, half)
    one, two = bt.fit(rows, [task])["half"], bt.fit(rows, [task])["half"]
    assert one.losses == two.losses
    for tree in one.trees:
        assert 1800 < tree.rows[0] < 2200
        assert len({f for f in tree.feature.tolist() if f >= 0}) <= 1


def test_composition_never_crosses(spark, data, rows):
    models = bt.fit_composition(rows, (0.5, 0.75, 0.9), PARAMS)[0]
    out = bt.composed(data[2], models)
    assert out.filter(~vectors.is_monotone(F.col("q"))).count() == 0
    first = out.first()
    assert first["q"][0] == first["steps"][0] and first["q"][1] >= first["q"][0]
    cover = out.agg(F.avg((F.col(TARGET) <= F.col("q")[2]).cast("int"))).first()[0]
    assert cover == pytest.approx(0.9, abs=0.05)


def test_contributions_add_up(spark, data, rows):
    model = bt.fit(rows, [bt.Task("a", 0.75, PARAMS)])["a"]
    out = data[2].select(bt.predictions(spark, [model])[0].alias("q"), bt.contributions(spark, model).alias("c"))
    for r in out.collect():
        assert sum(r["c"]) == pytest.approx(r["q"] - model.base, abs=1e-6)
    assert {r["f1"] for r in out.select((F.col("c")[0] != 0).alias("f1")).collect()} >= {True}


def test_node_tables_come_back_as_the_same_models(spark, data, rows, tmp_path):
    models = list(bt.fit(rows, bt.bundle_tasks((0.5, 0.9), PARAMS)).values())
    bt.node_table(spark, models).write.parquet(str(tmp_path / "nodes"))
    back = bt.from_node_table(spark.read.parquet(str(tmp_path / "nodes")))
    both = data[2].select(bt.predictions(spark, models).alias("a"), bt.predictions(spark, back).alias("b"))
    assert both.filter("a = b").count() == 1500
    broken = spark.read.parquet(str(tmp_path / "nodes")).filter("not (round = 0 and node = 1)")
    with pytest.raises(ValueError):
        bt.from_node_table(broken)


def test_changed_artifacts_are_refused(spark, data, rows, tmp_path):
    models = list(bt.fit(rows, bt.bundle_tasks((0.5, 0.9), PARAMS)).values())
    small = {
        name: spark.createDataFrame([(1, 0.5, [1.0, 2.0])], "zone_id long, x double, embedding array<double>")
        for name in artifacts.STATIC
    }
    scorer = artifacts.serving(models, 12.5, "abc", artifacts.StaticTables(**small))
    path = str(tmp_path / "scorer")
    artifacts.save(spark, path, scorer)
    back = artifacts.load(spark, path)
    assert (back.width, back.levels, back.population) == (12.5, (0.5, 0.9), "abc")
    spark.createDataFrame([([0.5, 0.9], 99.0, "abc")], artifacts._SETTINGS).write.mode("overwrite").parquet(f"{path}/settings")
    with pytest.raises(ValueError, match="settings"):
        artifacts.load(spark, path)
    with pytest.raises(ValueError):
        artifacts.Artifacts(tuple(models), 1.0, (0.5, 0.75), "abc", back.static)


def test_search_halves_every_level(rows):
    space = bt.SearchSpace(rate=(0.1, 0.5), leaves=(4, 8), min_rows=(20, 50))
    found = bt.search(rows, (0.5, 0.9), 4, bt.BoostParams(depth=3, patience=2), (2, 4), space=space)
    for level, ranked in found.items():
        assert len(ranked) == 4 and ranked[0].stopped == "early" and ranked[0].level == level
        assert sum(m.stopped == "halved" for m in ranked) >= 2
        assert all(m.stopped != "rounds" for m in ranked)
        assert min(ranked[0].losses) <= min(min(m.losses) for m in ranked if m.stopped == "early")


def test_search_seeds_differ_by_level():
    space = bt.SearchSpace()
    drawn = [bt.candidates(PARAMS, a, 3, 0, space) for a in (0.5, 0.75, 0.9)]
    assert len({c[0].rate for c in drawn}) == 3
    assert bt.candidates(PARAMS, 0.5, 3, 0, space) == drawn[0]
    assert len({bt.search_seed(s, a) for s in range(3) for a in (0.05, 0.5, 0.75, 0.9, 0.95)}) == 15
    for p in (p for c in drawn for p in c):
        assert 0.02 <= p.rate <= 0.2 and 31 <= p.leaves <= 255 and 0.6 <= p.row_share <= 1 and 1e-3 <= p.l2 <= 10


def test_wrong_inputs_are_errors(spark, data, rows):
    with pytest.raises(ValueError):
        bt.BoostParams(row_share=0.0)
    with pytest.raises(ValueError):
        bt.fit(rows, [bt.Task("a", 0.5, PARAMS), bt.Task("a", 0.9, PARAMS)])
    empty = bt.prepare(data[0].withColumn(TARGET, F.lit(None).cast("double")), None, FEATURES, "trip_id")
    with pytest.raises(ValueError):
        bt.fit(empty, [bt.Task("a", 0.5, PARAMS)])


def test_historical_mean_falls_back(spark):
    rows = [(1, 2, 3600, 100)] * 30 + [(1, 2, 7200, 400)] * 5 + [(3, 4, 0, 1000)]
    train = spark.createDataFrame(rows, f"pu_zone long, do_zone long, request_local_s long, {TARGET} long")
    model = baselines.fit_historical_mean(train)
    asked = spark.createDataFrame([(1, 1, 2, 3700), (2, 1, 2, 7300), (3, 3, 4, 0), (4, 9, 9, 0)], "id int, pu_zone long, do_zone long, request_local_s long")
    got = {r["id"]: r["prediction"] for r in model.predict(asked).collect()}
    mean = (3000 + 2000 + 1000) / 36
    assert got == {1: 100.0, 2: pytest.approx(5000 / 35), 3: pytest.approx(mean), 4: pytest.approx(mean)}


def test_multiplier_goes_through_the_origin(spark):
    rows = [(0, 100.0, 200)] * 100 + [(3600, 100.0, 300)] * 50 + [(0, 0.0, 900)]
    train = spark.createDataFrame(rows, f"request_local_s long, free_flow_duration_s double, {TARGET} long")
    model = baselines.fit_free_flow_multiplier(train)
    asked = spark.createDataFrame([(1, 0, 50.0), (2, 3600, 50.0), (3, 0, 0.0), (4, 0, None)], "id int, request_local_s long, free_flow_duration_s double")
    got = {r["id"]: r["prediction"] for r in model.predict(asked).collect()}
    overall = (100 * 200 * 100 + 50 * 300 * 100) / (150 * 100 * 100)
    mean = (100 * 200 + 50 * 300 + 900) / 151
    assert got == {1: 100.0, 2: pytest.approx(50 * overall), 3: pytest.approx(mean), 4: pytest.approx(mean)}


def test_rows_travel_in_blocks(spark, rows):
    """A pass moves a row per block to Python, training and validation rows apart, and none is lost or changed."""
    blocks = bt._in_blocks(rows, [TARGET], [5.0, 7.0]).collect()
    assert len(blocks) <= 2 * spark.sparkContext.defaultParallelism
    asked = {(r["row_key"], r[TARGET], bytes(r["bins"]), r["is_valid"]) for r in rows.table.collect()}
    found = set()
    for b in blocks:
        key, y = np.frombuffer(b["key"], np.int64), np.frombuffer(b["y"])
        bins = np.frombuffer(b["bins"], np.int8).reshape(len(FEATURES), -1).T
        assert (np.frombuffer(b["p"]).reshape(2, -1) == [[5.0], [7.0]]).all()
        found |= {(int(k), float(v), x.tobytes(), b["is_valid"]) for k, v, x in zip(key, y, bins, strict=True)}
    assert found == asked and len(asked) == 5500


def test_composition_takes_models_that_are_there(rows, monkeypatch):
    seeds, levels = (0, 1), (0.5, 0.9)
    few = bt.BoostParams(rounds=3, rate=0.5, leaves=4, depth=2, min_rows=20, row_share=0.7)
    tasks = bt.bundle_tasks(levels, few, seeds)
    fitted = bt.fit(rows, tasks)
    fits, fit = [], bt.fit
    monkeypatch.setattr(bt, "fit", lambda *a: fits.append(a) or fit(*a))
    alone = bt.fit_composition(rows, levels, few, seeds)
    given = bt.fit_composition(rows, levels, few, seeds, [fitted[f"seed{s}_p50"] for s in seeds])
    assert len(fits) == 3
    for s in seeds:
        for a, b in zip(alone[s], given[s], strict=True):
            assert (a.name, a.start, a.losses) == (b.name, b.start, b.losses)
            assert all((x.value == y.value).all() for x, y in zip(a.trees, b.trees, strict=True))


def test_smaller_leaf_is_counted_and_its_sibling_is_what_is_left(spark, rows, data):
    """The counts that a pass doesn't make are those that counting would have found; the root's signs are packed."""
    labels, starts, edges = [TARGET], [800.0, 1200.0, 1300.0], rows.edges
    shape = bt._Shape(len(FEATURES), 1, 3, (0, 0, 0))
    state = bt._in_blocks(rows, labels, starts)
    sprouts = [bt._Sprout(i, 0, bt.Task(str(i), 0.5, PARAMS), 0, (0, 1), 1000.0) for i in range(3)]
    for s, counts in zip(sprouts, bt._histogram_pass(state, shape, sprouts, True).values(), strict=True):
        assert counts.pop(-1) > 0
        s.note(counts)
        s.split(edges)
        assert len(s.counted) == 1 and len(s.fresh) == 2
    parent = {s.at: s.held[0] for s in sprouts}
    found = bt._histogram_pass(state, shape, sprouts, False)
    train = data[0].toPandas()
    for s in sprouts:
        s.note(found[s.at])
        feature, threshold = s.nodes[0]["feature"], s.nodes[0]["threshold"]
        left = ~(train[FEATURES[feature]].to_numpy() > threshold)
        small, large = s.counted[0], next(n for n in s.fresh if n not in s.counted)
        assert found[s.at][small][0].sum() == min(left.sum(), (~left).sum())
        for node, here in ((1, left), (2, ~left)):
            counts = found[s.at][node] if node == small else parent[s.at] - found[s.at][small]
            x, y = train[FEATURES[0]].to_numpy()[here], train[TARGET].to_numpy()[here]
            bins = np.where(np.isnan(x), 0, 1 + np.searchsorted(np.array(edges[0]), x, "left"))
            for sign in (0, 1):
                want = np.bincount(bins[(y > starts[s.at]) == bool(sign)], minlength=bt.BINS)
                assert (counts[0, :, sign] == want).all()
        assert large not in s.held or (s.held[large] == parent[s.at] - found[s.at][small]).all()


def test_thresholds_stand_at_even_ranks_of_known_values(spark):
    """Missing values, NaN as well as null, take no thresholds; a feature with few values has them exactly."""
    n = 30_000
    frame = spark.range(0, n, 1, 7).select(
        F.when(F.col("id") % 2 == 0, F.pow(F.col("id") / n, 3)).otherwise(F.lit(float("nan"))).alias("half"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("few"),
        F.lit(None).cast("double").alias("none"),
    )
    half, few, none = bt.feature_edges(frame, ("half", "few", "none"))
    known = np.sort((np.arange(0, n, 2) / n) ** 3)
    assert len(half) == bt.BINS - 2 and not np.isnan(half).any()
    ranks = np.searchsorted(known, half, "right") / len(known)
    assert np.abs(ranks - np.arange(1, bt.BINS - 1) / (bt.BINS - 1)).max() < 0.001
    assert few == (0.0, 1.0, 2.0, 3.0, 4.0) and none == ()


def test_rows_are_written_one_by_one_and_removed(spark, rows, monkeypatch):
    """A reader of files holds thousands of rows at once, so what is written between rounds are rows and no blocks; a fit
    that goes on from them is the same, and leaves no files behind."""
    import os

    task = bt.Task("a", 0.75, bt.BoostParams(rounds=4, rate=0.5, leaves=8, depth=3, min_rows=20, row_share=0.7))
    whole = bt.fit(rows, [task])["a"]
    seen, written = [], bt.written

    def noted(table, name):
        out, path = written(table, name)
        seen.append((out.count(), max(len(r["p"]) for r in out.select("p").collect()), path.removeprefix("file:")))
        return out, path

    monkeypatch.setattr(bt, "written", noted)
    monkeypatch.setattr(bt, "WRITE_EVERY", 2)
    cut = bt.fit(rows, [task])["a"]
    assert [(n, size) for n, size, _ in seen] == [(5500, 8)] * 2
    assert not any(os.path.exists(path) for _, _, path in seen)
    assert cut.losses == pytest.approx(whole.losses, rel=1e-12) and len(cut.trees) == len(whole.trees)
    for s, t in zip(cut.trees, whole.trees, strict=True):
        assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and (s.value == t.value).all()


def test_rows_of_spark_stay_small_whatever_the_models(spark):
    """A block of many models is still some hundred KB."""
    n = 20_000
    frame = spark.range(0, n, 1, 1).select(
        F.col("id").alias("trip_id"), F.rand(1).alias("f1"), F.rand(2).alias("f2"), F.rand(3).alias(TARGET)
    )
    blocks = bt._in_blocks(bt.prepare(frame, None, FEATURES, "trip_id"), [TARGET], [0.5] * 24).collect()
    assert sum(len(b["key"]) for b in blocks) == 8 * n
    assert max(sum(len(b[c]) for c in ("key", "y", "bins", "p", "signs")) for b in blocks) < 1 << 18


def test_tree_walk_is_the_same_for_all_rows_at_once():
    tree = bt.Tree(
        np.array([1, 0, -1, -1, -1], np.int32), np.zeros(5, np.int32), np.array([0.5, -1.0, 0.0, 0.0, 0.0]),
        np.array([1, 3, 0, 0, 0], np.int32), np.array([2, 4, 0, 0, 0], np.int32), np.array([0.0, 0.0, 7.0, 1.0, 2.0]),
        np.zeros(5, np.int64),
    )
    table = np.array([[0.0, 0.4], [-3.0, 0.5], [0.0, 0.6], [np.nan, 0.1], [5.0, np.nan]])
    assert tree.leaves(table, tree.threshold).tolist() == [4, 3, 2, 3, 4]
    total = np.ones(5)
    tree.add_to(total, table, tree.threshold)
    assert total.tolist() == [3.0, 2.0, 8.0, 2.0, 3.0]
