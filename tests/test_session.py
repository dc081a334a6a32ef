import shutil

from pyspark.sql import functions as F

from tripspark import session
from tripspark.plans import catalog


def test_derived_tables_are_written_once_and_rebuilt_when_gone(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(10).withColumn("k", F.col("id") % 2)

    scope = str(tmp_path)
    for _ in range(2):
        assert session.written_once(spark, scope, "numbers", build, ["k"]).count() == 10
    assert len(built) == 1
    key = (spark.sparkContext.applicationId, scope, "numbers")
    path = session._WRITTEN[key][0]
    assert path.startswith(session.shared_dir(spark))
    moved = str(tmp_path.parent / f"{tmp_path.name}-moved")
    shutil.move(path.removeprefix("file:"), moved)
    assert session.written_once(spark, scope, "numbers", build, ["k"]).count() == 10
    assert len(built) == 2
    (tmp_path / "rewritten.parquet").write_bytes(b"x")
    assert session.written_once(spark, scope, "numbers", build, ["k"]).count() == 10
    assert len(built) == 3


def test_split_filter_prunes_folders(spark, sf_dir):
    from tripspark.sources import driver_tables as d

    plan = d.enriched(spark, sf_dir).filter("split = 'val'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_scans_read_only_the_columns_a_query_needs(spark, sf_dir):
    plan = catalog.load()["zone_completions"].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert "trip_id" not in schema and "operator" not in schema and "PushedFilters: [" in plan


def test_no_registered_plan_multiplies_two_tables(spark, sf_dir):
    """Spot check of the joins that could turn into products."""
    for name in ("requests_with_state", "mondrian_conformal_intervals", "zone_pair_matrix", "scored_requests"):
        plan = catalog.load()[name].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_flagship_runs_on_the_smallest_tables(spark):
    import __spark_entry__ as driver

    out = driver.entry(spark)
    assert out.columns and out.count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_queries_over_one_split_or_plain_trips_dont_write_all_enriched_trips(spark, tmp_path):
    """They give the same rows whether the application has the enriched trips or not."""
    from tripspark.sources import driver_tables as d

    scope = str(tmp_path / "tables")
    shutil.copytree("/root/testdata/sf0.001", scope)
    names = ("night_zone_speed", "zone_embeddings", "thinnest_cells", "mondrian_conformal_fit")
    found = lambda: [sorted(map(repr, catalog.load()[n].run(spark, scope).collect())) for n in names]
    alone = found()
    assert session.already_written(spark, scope, "enriched") is None
    whole, part = d.enriched(spark, scope).filter("split = 'cal'"), d.enriched_splits(spark, scope, ("cal",))
    assert part.count() == whole.count() > 0 and part.exceptAll(whole).isEmpty()
    for key in [k for k in session._WRITTEN if k[1] == scope and k[2] not in ("enriched", "trips")]:
        del session._WRITTEN[key]
    assert found() == alone
