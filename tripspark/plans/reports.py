"""Queries for report tables, artifacts and small input files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripspark.operators import evaluation as ev
from tripspark.plans import reference
from tripspark.plans.catalog import query
from tripspark.plans.evaluation import COST, LEVELS, MIN_ROWS, by_model_and_seed, seed_results
from tripspark.plans.reference import rounded, sql_rounded
from tripspark.session import fresh_path
from tripspark.sources import driver_tables as d, reports, trip_files
from tripspark.operators.boosting import BoostParams
from tripspark.operators.cleaning import clean


@query(
    "zone_lookup_file",
    "S4",
    """SELECT z.zone_id, z.borough, z.zone_name, COUNT(t.trip_id) AS trips FROM zones z
       LEFT JOIN clean t ON z.zone_id = t.pu_zone GROUP BY 1, 2, 3""",
)
def zone_lookup_file(spark, sf):
    path = fresh_path(spark, "zone-lookup")
    d.zones(spark, sf).select(
        F.col("zone_id").alias("LocationID"),
        F.col("borough").alias("Borough"),
        F.col("zone_name").alias("Zone"),
        F.lit("Yellow Zone").alias("service_zone"),
    ).write.option("header", "true").csv(path)
    used = clean(d.trips(spark, sf)).groupBy(F.col("pu_zone").alias("zone_id")).agg(F.count("*").alias("trips"))
    lookup = trip_files.read_zone_lookup(spark, path).join(used, "zone_id", "left")
    return lookup.select("zone_id", "borough", "zone_name", F.coalesce("trips", F.lit(0)).alias("trips"))


@query(
    "seed_results_read_back",
    "S8 S11",
    f"SELECT model, seed, rows, {sql_rounded('business_cost', 'late_rate')} FROM seed_results",
)
def seed_results_read_back(spark, sf):
    """Seed results and their segments, written as JSON and read with a fixed schema."""
    path = fresh_path(spark, "seed-results")
    segments = ev.evaluate(by_model_and_seed(d.scored(spark, sf)), COST, keys=["model", "seed"], min_rows=MIN_ROWS)
    nested = reports.with_segments(seed_results(spark, sf), segments.filter("axis <> 'global'"))
    reports.write_report(nested, path)
    back = reports.read_seed_results(spark, path).filter(F.size("segments") > 0)
    return back.select("model", "seed", "rows", *rounded("business_cost", "late_rate"))


@query(
    "tuned_or_default_parameters",
    "S11",
    """SELECT level, CASE WHEN level IN (0.5, 0.9) THEN level / 10 ELSE 0.3 END AS rate,
       CAST(CASE WHEN level IN (0.5, 0.9) THEN 40 ELSE 31 END AS INTEGER) AS leaves,
       CASE WHEN level IN (0.5, 0.9) THEN 0.75::DOUBLE ELSE 1.0 END AS row_share, CAST(level IN (0.5, 0.9) AS INTEGER) AS is_tuned,
       COUNT(*) AS rows FROM scored, (VALUES (CAST(0.05 AS DOUBLE)), (0.5), (0.75), (0.9), (0.95)) l(level) GROUP BY 1""",
)
def tuned_or_default_parameters(spark, sf):
    path = fresh_path(spark, "tuned")
    per_level = d.scored(spark, sf).select(F.explode(F.array(*map(F.lit, LEVELS))).alias("level"))
    levels = per_level.groupBy("level").agg(F.count("*").alias("rows"))
    found = levels.filter(F.col("level").isin(0.5, 0.9)).select(
        "level", (F.col("level") / 10).alias("rate"), F.lit(40).alias("leaves"), F.lit(80).alias("min_rows"),
        F.lit(0.75).alias("row_share"),
    )
    reports.write_report(found, path)
    tuned = reports.tuned_parameters(spark, path, levels.select("level"), BoostParams())
    return tuned.join(levels, "level").select(
        "level", "rate", "leaves", "row_share", F.col("is_tuned").cast("int").alias("is_tuned"), "rows"
    )


_KEYS = ("trip_id", "pu_zone", "do_zone", "total_time_s")
_TEXT = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in _KEYS)


@query(
    "artifact_manifest",
    "S10",
    f"""
WITH h AS (SELECT CAST('0x' || substr(md5({_TEXT}), 1, 8) AS BIGINT) AS v FROM clean),
m AS (SELECT CAST('0x' || substr(md5(CAST(pu_zone AS VARCHAR) || '|' || CAST(do_zone AS VARCHAR)), 1, 8) AS BIGINT) AS v
      FROM matrix)
SELECT 'clean_trips' AS artifact, COUNT(*) AS rows, CAST(SUM(v) AS VARCHAR) AS content_sum, BIT_XOR(v) AS content_xor,
       'eight row rules' AS provenance FROM h
UNION ALL SELECT 'zone_pair_matrix', COUNT(*), CAST(SUM(v) AS VARCHAR), BIT_XOR(v), 'train split only' FROM m""",
)
def artifact_manifest(spark, sf):
    return reports.manifest(
        {
            "clean_trips": (clean(d.trips(spark, sf)), _KEYS, "eight row rules"),
            "zone_pair_matrix": (reference.matrix(spark, sf), ("pu_zone", "do_zone"), "train split only"),
        }
    )
