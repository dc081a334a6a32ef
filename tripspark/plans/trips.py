"""Queries over raw and enriched trips: cleaning, audit, segments, weather, zone state, data card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripspark.config import check_settings
from tripspark.functions import clock, sampling, segments
from tripspark.operators import card, cleaning, ingest, weather, zone_state
from tripspark.plans.catalog import query
from tripspark.plans.oracle import VIEWS
from tripspark.session import fresh_path
from tripspark.sources import driver_tables as d, trip_files
from tripspark.vocab import SEGMENT_COLUMNS, WEATHER_COLUMNS

RULES = cleaning.RULE_NAMES

# ---- sources ---------------------------------------------------------------------------------------------

RAW_SQL = """
SELECT event_id, CAST(ts AS TIMESTAMP) + INTERVAL 68 DAY AS wall FROM events"""


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event times as naive local times, shifted so that they cross the March clock change."""
    wall = F.col("ts") + F.expr("INTERVAL 68 DAYS")
    return d.table(spark, sf, "events").select("event_id", wall.alias("wall"))


@query(
    "local_time_to_instant",
    "S1 P12",
    f"""
WITH raw AS ({RAW_SQL}),
utc AS (SELECT event_id, CAST(FLOOR(epoch(wall)) AS BIGINT) AS wall_s,
        (wall AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS u,
        ((wall AT TIME ZONE 'America/New_York') AT TIME ZONE 'America/New_York') = wall AS real_time FROM raw)
SELECT event_id, CASE WHEN real_time THEN CAST(FLOOR(epoch(u)) AS BIGINT) END AS instant_s,
       CASE WHEN real_time THEN wall_s END AS local_s FROM utc""",
)
def local_time_to_instant(spark, sf):
    instant = clock.instant_seconds(F.col("wall"))
    return raw_events(spark, sf).select(
        "event_id", instant.alias("instant_s"), clock.local_seconds(instant).alias("local_s")
    )


@query(
    "file_readability",
    "S2 S5",
    """SELECT 'lineitem.parquet' AS file, COUNT(*) AS rows, MAX(l_orderkey) AS newest FROM lineitem""",
)
def file_readability(spark, sf):
    return trip_files.file_check(spark, f"{sf}/lineitem.parquet", "l_orderkey")


@query(
    "month_files_written",
    "S6 N10",
    """SELECT strftime(make_timestamp(request_local_s * 1000000), '%Y-%m') AS month, COUNT(*) AS rows
       FROM clean GROUP BY 1""",
)
def month_files_written(spark, sf):
    counts = trip_files.write_months(cleaning.clean(d.trips(spark, sf)), fresh_path(spark, "months"))
    return counts.select(F.col("month").cast("string").alias("month"), "rows")


@query(
    "months_without_trips",
    "S7",
    """SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(DATE '1994-11-01', DATE '2001-10-01',
       INTERVAL 1 MONTH)) AS m)
       WHERE strftime(m, '%Y-%m') NOT IN
         (SELECT strftime(make_timestamp(request_local_s * 1000000), '%Y-%m') FROM trips)""",
)
def months_without_trips(spark, sf):
    return trip_files.missing_months(d.trips(spark, sf), "1994-11", "2001-10")


# ---- cleaning --------------------------------------------------------------------------------------------


@query(
    "rule_audit",
    "F1 F2 F3 F4 F5 F6 F7 F8 F10",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS rule, COUNT(*) AS rows, COUNT(*) FILTER (NOT k{i}) AS rejected,
            ROUND(100.0 * COUNT(*) FILTER (NOT k{i}) / COUNT(*), 4) AS pct FROM ruled"""
        for i, name in enumerate(RULES, 1)
    ),
)
def rule_audit(spark, sf):
    return cleaning.audit(d.trips(spark, sf))


@query(
    "monthly_cleaning_report",
    "F11",
    f"""
WITH dated AS (SELECT *, strftime(make_timestamp(request_local_s * 1000000), '%Y-%m') AS m,
               k1 AND k2 AND k3 AND k4 AND k5 AND k6 AND k7 AND k8 AS kept FROM ruled)
SELECT COALESCE(m, 'all') AS month, COUNT(*) AS rows_in, COUNT(*) FILTER (kept) AS rows_out,
       COUNT(*) FILTER (NOT kept) AS rows_dropped,
       ROUND(100.0 * COUNT(*) FILTER (NOT kept) / COUNT(*), 4) AS pct_dropped,
       {", ".join(f"COUNT(*) FILTER (NOT k{i}) AS {name}" for i, name in enumerate(RULES, 1))}
FROM dated GROUP BY ROLLUP (m)""",
)
def monthly_cleaning_report(spark, sf):
    return cleaning.monthly_report(d.trips(spark, sf))


@query(
    "clean_trips",
    "F9 P1",
    """SELECT trip_id, operator, pu_zone, do_zone, total_time_s, dispatch_approach_s, curb_wait_s, trip_duration_s
       FROM clean""",
)
def clean_trips(spark, sf):
    return cleaning.clean(d.trips(spark, sf)).select(
        "trip_id", "operator", "pu_zone", "do_zone", "total_time_s", "dispatch_approach_s", "curb_wait_s",
        "trip_duration_s",
    )


@query(
    "unreconciled_components",
    "F12",
    """SELECT trip_id, total_time_s, dispatch_approach_s + curb_wait_s + trip_time AS parts FROM clean
       WHERE ABS(dispatch_approach_s + curb_wait_s + trip_time + (trip_id % 7) - total_time_s) > 3""",
)
def unreconciled_components(spark, sf):
    # The metered time, off by a few seconds, stands in for a component that does not add up.
    metered = cleaning.clean(d.trips(spark, sf)).withColumn(
        "trip_duration_s", F.col("trip_time") + F.col("trip_id") % 7
    )
    parts = F.col("dispatch_approach_s") + F.col("curb_wait_s") + F.col("trip_time")
    return cleaning.unreconciled(metered, 3.0).select("trip_id", "total_time_s", parts.alias("parts"))


@query(
    "component_complete_rows",
    "F13",
    """SELECT operator, COUNT(*) AS rows, CAST(SUM(dispatch_approach_s) AS BIGINT) AS dispatch_s,
              CAST(SUM(curb_wait_s) AS BIGINT) AS curb_s, CAST(SUM(trip_duration_s) AS BIGINT) AS ride_s
       FROM clean WHERE ABS(dispatch_approach_s + curb_wait_s + trip_duration_s - total_time_s) <= 1 GROUP BY 1""",
)
def component_complete_rows(spark, sf):
    return cleaning.component_complete(cleaning.clean(d.trips(spark, sf))).groupBy("operator").agg(
        F.count("*").alias("rows"),
        F.sum("dispatch_approach_s").alias("dispatch_s"),
        F.sum("curb_wait_s").alias("curb_s"),
        F.sum("trip_duration_s").alias("ride_s"),
    )


@query(
    "sampling_tiers",
    "P8 P9 N14",
    """
WITH h AS (SELECT trip_id, CAST(('0x' || substr(md5(CAST(trip_id AS VARCHAR) || '|' || CAST(pu_zone AS VARCHAR)), 1, 8))
           AS BIGINT) % 10000 AS key_hash FROM clean)
SELECT trip_id, CAST(key_hash AS INTEGER) AS key_hash, CAST(key_hash < 300 AS INTEGER) AS in_tune FROM h
WHERE key_hash < 2500""",
)
def sampling_tiers(spark, sf):
    clean = cleaning.clean(d.trips(spark, sf))
    hashed = clean.withColumn("key_hash", sampling.key_hash(clean, ("trip_id", "pu_zone", "absent")))
    return hashed.filter(sampling.in_tier(F.col("key_hash"), "ablation")).select(
        "trip_id", "key_hash", sampling.in_tier(F.col("key_hash"), "tune").cast("int").alias("in_tune")
    )


SAMPLE_ROWS = 5_000


@query(
    "sample_of_exact_size",
    "N14",
    f"""SELECT trip_id, pu_zone FROM clean ORDER BY CAST('0x' || substr(md5('0|' || CAST(trip_id AS VARCHAR) || '|' ||
        CAST(pu_zone AS VARCHAR)), 1, 15) AS BIGINT), trip_id, pu_zone LIMIT {SAMPLE_ROWS}""",
)
def sample_of_exact_size(spark, sf):
    """A seeded sample without replacement: its size is the feature."""
    clean = cleaning.clean(d.trips(spark, sf))
    return sampling.sample_of_size(clean, ("trip_id", "pu_zone"), SAMPLE_ROWS).select("trip_id", "pu_zone")


# ---- ingest ----------------------------------------------------------------------------------------------

VIEWS["raw_trips"] = f"""
SELECT event_id, wall, event_id % 3 AS part, CASE WHEN event_id % 3 <> 2 THEN wall + INTERVAL 3 MINUTE END AS on_scene,
       wall + to_minutes(5 + event_id % 20) AS pickup, wall + to_minutes(9 + event_id % 70) AS dropoff,
       user_id % 266 + 1 AS pu_zone, event_id % 264 + 1 AS do_zone,
       CAST(CASE WHEN event_id % 3 = 1 THEN CAST(value / 8 AS FLOAT) ELSE value / 8 END AS DOUBLE) AS trip_miles,
       240 + event_id % 900 AS trip_time
FROM ({RAW_SQL}) JOIN (SELECT event_id, user_id, value FROM events) USING (event_id)"""


def _instant_sql(column: str) -> str:
    real = f"(({column} AT TIME ZONE 'America/New_York') AT TIME ZONE 'America/New_York') = {column}"
    return f"CASE WHEN {real} THEN CAST(FLOOR(epoch(({column} AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC')) AS BIGINT) END"


VIEWS["ingested"] = f"""
SELECT part, {_instant_sql('wall')} AS request_s,
       CASE WHEN {_instant_sql('wall')} IS NOT NULL THEN CAST(FLOOR(epoch(wall)) AS BIGINT) END AS request_local_s,
       {_instant_sql('on_scene')} AS on_scene_s, {_instant_sql('pickup')} AS pickup_s, {_instant_sql('dropoff')} AS dropoff_s,
       pu_zone, do_zone, trip_miles, trip_time, on_scene IS NOT NULL AS has_scene FROM raw_trips"""
VIEWS["ingest_ruled"] = VIEWS["ruled"].replace("FROM trips", "FROM ingested")


def raw_trip_files(spark: SparkSession, sf: str) -> str:
    """Three layouts of raw trip files in folders of their own, and a file that is no Parquet; returns the folder."""
    path = fresh_path(spark, "raw-trips")
    events = d.table(spark, sf, "events")
    wall = F.col("ts") + F.expr("INTERVAL 68 DAYS")
    later = lambda minutes: wall + F.make_dt_interval(mins=minutes)
    raw = events.select(
        (F.col("event_id") % 3).alias("part"),
        F.lit("HV0003").alias("hvfhs_license_num"),
        wall.alias("request_datetime"),
        later(F.lit(3)).alias("on_scene_datetime"),
        later((5 + F.col("event_id") % 20).cast("int")).alias("pickup_datetime"),
        later((9 + F.col("event_id") % 70).cast("int")).alias("dropoff_datetime"),
        (F.col("user_id") % 266 + 1).alias("PULocationID"),
        (F.col("event_id") % 264 + 1).alias("DOLocationID"),
        (F.col("value") / 8).alias("trip_miles"),
        (240 + F.col("event_id") % 900).alias("trip_time"),
    )
    full = raw.filter("part = 0").drop("part")
    narrow = raw.filter("part = 1").drop("part").withColumns(
        {c: F.col(c).cast("int") for c in ("PULocationID", "DOLocationID", "trip_time")}
    )
    narrow = narrow.withColumn("trip_miles", F.col("trip_miles").cast("float")).withColumn("extra_fee", F.lit(1.0))
    old = raw.filter("part = 2").drop("part", "on_scene_datetime")
    for name, frame in (("full", full), ("narrow", narrow), ("old", old)):
        frame.write.parquet(f"{path}/layout={name}")
    spark.createDataFrame([("a download that broke off",)], "value string").coalesce(1).write.text(f"{path}/layout=broken")
    return path


@query(
    "raw_file_outcomes",
    "S1 S2 S5",
    """SELECT CASE part WHEN 0 THEN 'full' WHEN 1 THEN 'narrow' ELSE 'old' END AS layout, 'read' AS status, COUNT(*) AS rows,
       COUNT(*) FILTER (request_s IS NULL) + COUNT(*) FILTER (on_scene_s IS NULL AND has_scene) + COUNT(*) FILTER (pickup_s IS NULL)
       + COUNT(*) FILTER (dropoff_s IS NULL) AS gap_nulls, CASE WHEN part = 2 THEN 'on_scene_datetime' ELSE '' END AS lacking
       FROM ingested GROUP BY part UNION ALL SELECT 'broken', 'damaged', 0, 0, ''""",
)
def raw_file_outcomes(spark, sf):
    """Files of three layouts and a damaged one, found by glob: rows, times lost in the clock change, columns lacking."""
    path = raw_trip_files(spark, sf)
    found = ingest.ingest(spark, f"{path}/layout=*/*").outcomes.filter("status <> 'empty'")
    layout = F.regexp_extract("file", "layout=([a-z]+)/", 1)
    return found.groupBy(layout.alias("layout"), "status").agg(
        F.sum("rows").alias("rows"),
        F.sum("gap_nulls").alias("gap_nulls"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lacking")))), ",").alias("lacking"),
    )


@query(
    "raw_ingest_report",
    "S1 S5 F11",
    """SELECT COALESCE(month, CASE WHEN g = 1 THEN 'all' ELSE 'unknown' END) AS month, rows_in, rows_out, rows_in - rows_out AS rows_dropped,
       timestamps_present, zones_routable FROM (
       SELECT strftime(make_timestamp(request_local_s * 1000000), '%Y-%m') AS month,
              GROUPING(strftime(make_timestamp(request_local_s * 1000000), '%Y-%m')) AS g, COUNT(*) AS rows_in,
              COUNT(*) FILTER (k1 AND k2 AND k3 AND k4 AND k5 AND k6 AND k7 AND k8) AS rows_out,
              COUNT(*) FILTER (NOT k1) AS timestamps_present, COUNT(*) FILTER (NOT k8) AS zones_routable
       FROM ingest_ruled GROUP BY ROLLUP (strftime(make_timestamp(request_local_s * 1000000), '%Y-%m')))""",
)
def raw_ingest_report(spark, sf):
    report = ingest.ingest(spark, f"{raw_trip_files(spark, sf)}/layout=*/*").report()
    return report.select("month", "rows_in", "rows_out", "rows_dropped", "timestamps_present", "zones_routable")


# ---- settings --------------------------------------------------------------------------------------------


@query(
    "zone_settings_check",
    "P30 P29 P31",
    """SELECT pu_zone, trips, ROUND((2 + pu_zone % 4) / (3.0 + pu_zone % 4), 6) AS served_level,
       CAST(pu_zone % 4 = 1 AS INTEGER) AS serves, CAST(pu_zone % 3 <> 0 AS INTEGER) AS brackets,
       CAST(pu_zone % 5 <> 0 AS INTEGER) AS ascends, CAST(pu_zone % 2 = 0 AS INTEGER) AS enough_seeds
       FROM (SELECT pu_zone, COUNT(*) AS trips FROM clean GROUP BY 1)""",
)
def zone_settings_check(spark, sf):
    """Cost rates, levels and seeds that each pickup zone asks for, checked as the settings of a job are."""
    zone = F.col("pu_zone")
    asked = cleaning.clean(d.trips(spark, sf)).groupBy("pu_zone").agg(F.count("*").alias("trips")).withColumns(
        {
            "lambda_late": (2 + zone % 4).cast("double"),
            "lambda_early": F.lit(1.0),
            "levels": F.when(zone % 5 == 0, F.array(*map(F.lit, (0.05, 0.75, 0.5, 0.9, 0.95)))).otherwise(
                F.array(*map(F.lit, (0.05, 0.5, 0.75, 0.9, 0.95)))
            ),
            "coverage": F.when(zone % 3 == 0, 0.8).otherwise(0.9),
            "seeds": F.when(zone % 2 == 0, F.array(*map(F.lit, (0, 1, 2)))).otherwise(F.array(*map(F.lit, (0, 1)))),
        }
    )
    out = check_settings(asked)
    flags = [F.col(c).cast("int").alias(c) for c in ("serves", "brackets", "ascends", "enough_seeds")]
    return out.select("pu_zone", "trips", F.round("served_level", 6).alias("served_level"), *flags)


# ---- weather and segments --------------------------------------------------------------------------------

def _rounded(names, digits=6):
    return [F.round(F.col(c).cast("double"), digits).alias(c) for c in names]


def _sql_rounded(names, digits=6):
    return ", ".join(f"ROUND(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in names)


@query(
    "weather_reports_parsed",
    "S3 P10 P11 A2",
    f"SELECT station, hour_s, {_sql_rounded(WEATHER_COLUMNS)} FROM weather_hours",
)
def weather_reports_parsed(spark, sf):
    path = fresh_path(spark, "reports")
    d.weather_reports(spark, sf).write.option("header", "true").csv(path)
    parsed = weather.parse_reports(trip_files.read_weather_reports(spark, path))
    return weather.hourly(parsed).select("station", "hour_s", *_rounded(WEATHER_COLUMNS))


@query(
    "weather_hours_filled",
    "J9 N2 N12",
    f"SELECT station, hour_s, {_sql_rounded(WEATHER_COLUMNS)} FROM weather_filled",
)
def weather_hours_filled(spark, sf):
    return d.filled_weather(spark, sf).select("station", "hour_s", *_rounded(WEATHER_COLUMNS))


@query(
    "weather_still_missing",
    "A34",
    "SELECT station, COUNT(*) AS hours, "
    + ", ".join(f"COUNT(*) FILTER ({c} IS NULL) AS {c}_missing" for c in WEATHER_COLUMNS)
    + " FROM weather_filled GROUP BY 1",
)
def weather_still_missing(spark, sf):
    return weather.null_counts(d.filled_weather(spark, sf))


@query(
    "trips_by_station",
    "P13 P14",
    """SELECT z.station, CASE WHEN t.pu_zone = 132 THEN 'jfk' WHEN t.pu_zone IN (138, 1) THEN 'lga' ELSE 'central_park' END
              AS rule_station, COUNT(*) AS trips, ROUND(AVG(z.km), 4) AS mean_km
       FROM clean t JOIN zone_stations z ON t.pu_zone = z.zone_id GROUP BY 1, 2""",
)
def trips_by_station(spark, sf):
    stations = weather.station_by_zone(d.zones(spark, sf))
    return (
        cleaning.clean(d.trips(spark, sf))
        .join(stations, "pu_zone")
        .groupBy("station", weather.station_by_rule(F.col("pu_zone")).alias("rule_station"))
        .agg(F.count("*").alias("trips"), F.round(F.avg("station_km"), 4).alias("mean_km"))
    )


@query(
    "trip_weather",
    "J1",
    f"SELECT trip_id, {_sql_rounded(WEATHER_COLUMNS, 4)} FROM enriched",
)
def trip_weather(spark, sf):
    joined = weather.join_weather(
        cleaning.clean(d.trips(spark, sf)), d.hourly_weather(spark, sf), weather.station_by_zone(d.zones(spark, sf))
    )
    return joined.select("trip_id", *_rounded(WEATHER_COLUMNS, 4))


@query(
    "segment_buckets",
    "P2 P3 P4 P5 P34 J2",
    """SELECT trip_id, seg_time, seg_trip_length, seg_zone_density, seg_weather,
              array_to_string(list_sort([seg_time, seg_zone_density, seg_weather]), '|') AS segment_key FROM enriched""",
)
def segment_buckets(spark, sf):
    key = segments.segment_key(F.col("seg_time"), F.col("seg_zone_density"), F.col("seg_weather"))
    return d.enrich_trips(spark, sf).select("trip_id", *SEGMENT_COLUMNS, key.alias("segment_key"))


@query(
    "splits_and_holdout_weeks",
    "P6 P7",
    """SELECT split, CAST(holdout_week AS INTEGER) AS holdout_week, COUNT(*) AS rows, MIN(request_s) AS first_s,
              MAX(request_s) AS last_s FROM enriched GROUP BY 1, 2""",
)
def splits_and_holdout_weeks(spark, sf):
    return d.enrich_trips(spark, sf).groupBy("split", F.col("holdout_week").cast("int").alias("holdout_week")).agg(
        F.count("*").alias("rows"), F.min("request_s").alias("first_s"), F.max("request_s").alias("last_s")
    )


# ---- zone state ------------------------------------------------------------------------------------------

_STATE = zone_state.state_columns()


@query(
    "zone_completions",
    "A1 P15",
    """SELECT zone, bucket_s, completed, ROUND(distance_m, 4) AS distance_m, CAST(duration_s AS BIGINT) AS duration_s
       FROM state_buckets""",
)
def zone_completions(spark, sf):
    return zone_state.completions(cleaning.clean(d.trips(spark, sf))).select(
        "zone", "bucket_s", "completed", F.round("distance_m", 4).alias("distance_m"), "duration_s"
    )


@query(
    "zone_state_rolling",
    "N1",
    f"SELECT zone, bucket_s, {_sql_rounded(_STATE, 4)} FROM ({VIEWS['zone_state'].replace('state_buckets', 'completions')})",
)
def zone_state_rolling(spark, sf):
    return zone_state.rolling_state(d.completions(spark, sf)).select("zone", "bucket_s", *_rounded(_STATE, 4))


@query(
    "requests_with_state",
    "J5",
    f"""
WITH st AS ({VIEWS['zone_state'].replace('state_buckets', 'completions')}),
rq AS (SELECT *, CAST(FLOOR(request_s / 300.0) AS BIGINT) * 300 AS key_s FROM requests)
SELECT request_id, state_bucket_s, {_sql_rounded(_STATE, 4)}
FROM (SELECT rq.request_id, st.bucket_s AS state_bucket_s, st.* EXCLUDE (bucket_s)
      FROM rq ASOF LEFT JOIN st ON rq.pu_zone = st.zone AND rq.key_s > st.bucket_s)""",
)
def requests_with_state(spark, sf):
    state = zone_state.rolling_state(d.completions(spark, sf))
    return zone_state.attach_state(d.requests(spark, sf), state).select(
        "request_id", "state_bucket_s", *_rounded(_STATE, 4)
    )


@query(
    "latest_zone_state",
    "N11",
    f"""SELECT zone, bucket_s, {_sql_rounded(_STATE, 4)} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY zone
        ORDER BY bucket_s DESC) AS rn FROM ({VIEWS['zone_state'].replace('state_buckets', 'completions')})) WHERE rn = 1""",
)
def latest_zone_state(spark, sf):
    state = zone_state.rolling_state(d.completions(spark, sf))
    return zone_state.last_state(state).select("zone", "bucket_s", *_rounded(_STATE, 4))


@query(
    "zone_state_decayed",
    "X2",
    """
WITH spread AS (SELECT *, unnest(generate_series(bucket_s, bucket_s + 3600, 300)) AS clock_s FROM completions)
SELECT zone, clock_s, """
    + ", ".join(
        f"ROUND(CAST(COALESCE(SUM({m}) FILTER (bucket_s > clock_s - {60 * w}), 0) AS DOUBLE), 4) AS {m}_{w}m"
        for w in (15, 30, 60)
        for m in ("completed", "distance_m", "duration_s")
    )
    + " FROM spread GROUP BY 1, 2",
)
def zone_state_decayed(spark, sf):
    return zone_state.decayed_state(d.completions(spark, sf)).select("zone", "clock_s", *_rounded(_STATE, 4))


# ---- data card -------------------------------------------------------------------------------------------


@query(
    "target_overview",
    "A12 N5",
    """
WITH r AS (SELECT total_time_s, ROW_NUMBER() OVER (ORDER BY total_time_s) AS rn, COUNT(*) OVER () AS n FROM clean)
SELECT COUNT(*) AS rows, ROUND(AVG(total_time_s), 4) AS mean, ROUND(stddev_samp(total_time_s), 4) AS std,
       MIN(total_time_s) AS min, MAX(total_time_s) AS max, """
    + ", ".join(
        f"MAX(CASE WHEN rn = FLOOR((n - 1) * CAST({q} AS DOUBLE) + 0.5) + 1 THEN CAST(total_time_s AS DOUBLE) END) AS {p}"
        for p, q in card.CARD_QUANTILES.items()
    )
    + " FROM r",
)
def target_overview(spark, sf):
    out = card.overall(cleaning.clean(d.trips(spark, sf)))
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


_AXES = ("split", *SEGMENT_COLUMNS)


@query(
    "target_by_bucket",
    "A14",
    "WITH "
    + ", ".join(
        f"""r_{a} AS (SELECT '{a}' AS axis, {a} AS bucket, total_time_s, COUNT(*) OVER () AS total,
        ROW_NUMBER() OVER (PARTITION BY {a} ORDER BY total_time_s) AS rn, COUNT(*) OVER (PARTITION BY {a}) AS n
        FROM enriched)"""
        for a in _AXES
    )
    + " "
    + " UNION ALL ".join(
        f"""SELECT axis, bucket, COUNT(*) AS rows, ROUND(100.0 * COUNT(*) / MAX(total), 4) AS share_pct,
        CAST(median(total_time_s) AS DOUBLE) AS p50,
        MAX(CASE WHEN rn = FLOOR((n - 1) * CAST(0.9 AS DOUBLE) + 0.5) + 1 THEN CAST(total_time_s AS DOUBLE) END) AS p90
        FROM r_{a} GROUP BY 1, 2"""
        for a in _AXES
    ),
)
def target_by_bucket(spark, sf):
    return card.by_bucket(d.enriched(spark, sf)).withColumn("share_pct", F.round("share_pct", 4))


_MISSABLE = ("on_scene_s", "dispatch_approach_s", "curb_wait_s", "temp_c", "wind_ms", "visibility_m", "snow_depth_cm")


@query(
    "missing_values",
    "A13",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", ROUND(100.0 * COUNT(*) FILTER ({c} IS NULL) / COUNT(*), 4) AS missing_pct
            FROM enriched"""
        for c in _MISSABLE
    ),
)
def missing_values(spark, sf):
    return card.missingness(d.enriched(spark, sf), _MISSABLE).withColumn("missing_pct", F.round("missing_pct", 4))


@query(
    "calibration_grid",
    "A15",
    """
WITH g AS (SELECT COUNT(*) AS rows FROM enriched WHERE split = 'cal' GROUP BY seg_time, seg_trip_length,
           seg_zone_density, seg_weather)
SELECT COUNT(*) AS cells, CAST(SUM(rows) AS BIGINT) AS rows, COUNT(*) FILTER (rows < 500) AS thin_cells,
       CAST(COALESCE(SUM(rows) FILTER (rows < 500), 0) AS BIGINT) AS rows_in_thin_cells, MIN(rows) AS smallest FROM g""",
)
def calibration_grid(spark, sf):
    return card.grid_viability(d.enriched_splits(spark, sf, ("cal",)), 500)


@query(
    "thinnest_cells",
    "N9",
    """SELECT seg_time, seg_trip_length, seg_zone_density, seg_weather, COUNT(*) AS rows FROM enriched
       WHERE split = 'cal' GROUP BY ALL HAVING COUNT(*) < 500
       ORDER BY rows, seg_time, seg_trip_length, seg_zone_density, seg_weather LIMIT 8""",
)
def thinnest_cells(spark, sf):
    return card.thinnest_cells(d.enriched_splits(spark, sf, ("cal",)), 500)


# ---- flagship --------------------------------------------------------------------------------------------


@query(
    "trip_time_and_zone_load",
    "F9 P1 P2 P6 A1 N1 J5 C1 C2 A14",
    """
WITH rq AS (SELECT *, CAST(FLOOR(request_s / 300.0) AS BIGINT) * 300 AS key_s FROM split_trips),
j AS (SELECT rq.split, rq.seg_time, rq.total_time_s, st.completed_60m,
             st.distance_m_60m / GREATEST(st.duration_s_60m, 1) AS speed
      FROM rq ASOF LEFT JOIN zone_state st ON rq.pu_zone = st.zone AND rq.key_s > st.bucket_s)
SELECT split, seg_time, COUNT(*) AS rows, CAST(median(total_time_s) AS DOUBLE) AS p50,
       ROUND(quantile_cont(CAST(total_time_s AS DOUBLE), 0.9), 4) AS p90,
       ROUND(AVG(completed_60m), 4) AS mean_zone_trips, ROUND(AVG(speed), 4) AS mean_zone_speed_ms
FROM j GROUP BY 1, 2""",
)
def trip_time_and_zone_load(spark, sf):
    """p50 and p90 trip time and mean zone load by split and time bucket, for clean trips."""
    return load_report(with_split_and_time(cleaning.clean(d.trips(spark, sf))))


def with_split_and_time(trips: DataFrame) -> DataFrame:
    local, cfg = F.col("request_local_s"), d.SETTINGS
    return trips.withColumns(
        {"split": segments.split_of(local, cfg.splits), "seg_time": segments.time_bucket(local, cfg.segments)}
    )


def load_report(trips: DataFrame) -> DataFrame:
    from tripspark.functions.scores import clip_low
    from tripspark.operators.orderstats import Quantile, group_quantiles

    keys = ["split", "seg_time"]
    loaded = zone_state.attach_state(trips, zone_state.zone_state(trips))
    speed = F.col("distance_m_60m") / clip_low(F.col("duration_s_60m"), 1.0)
    load = loaded.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.round(F.avg("completed_60m"), 4).alias("mean_zone_trips"),
        F.round(F.avg(speed), 4).alias("mean_zone_speed_ms"),
    )
    # Whole seconds under six hours: few distinct values per group, so one window over their counts is enough.
    times = group_quantiles(
        trips, keys, "total_time_s", {"p50": Quantile(0.5), "p90": Quantile(0.9)}
    )
    return load.join(times.drop("n"), keys).withColumn("p90", F.round("p90", 4))
