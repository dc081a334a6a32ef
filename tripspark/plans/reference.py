"""Queries for the reference tables built from the training split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripspark.operators import cleaning, reference_tables as ref
from tripspark.plans.catalog import query
from tripspark.plans.oracle import VIEWS
from tripspark.session import written_once
from tripspark.sources import driver_tables as d
from tripspark.sources.route_json import parse_route

NIGHT_FLOOR = 20
INTRA_FLOOR = 20

VIEWS["train"] = "SELECT * FROM enriched WHERE split = 'train'"
VIEWS["intra"] = f"""
SELECT pu_zone, CASE WHEN n >= {INTRA_FLOOR} THEN observed_m
         ELSE (SELECT regr_intercept(observed_m, root_area) FROM intra_base WHERE n >= {INTRA_FLOOR})
            + (SELECT regr_slope(observed_m, root_area) FROM intra_base WHERE n >= {INTRA_FLOOR}) * root_area END AS distance_m,
       COALESCE(n >= {INTRA_FLOOR}, FALSE) AS from_observation FROM intra_base"""
VIEWS["intra_base"] = """
SELECT z.zone_id AS pu_zone, sqrt(z.area_km2) AS root_area, o.n, o.miles * CAST(1609.344 AS DOUBLE) AS observed_m
FROM zones z LEFT JOIN (SELECT pu_zone, COUNT(*) AS n, median(trip_miles) AS miles FROM train
  WHERE pu_zone = do_zone AND trip_miles > 0 GROUP BY 1) o ON z.zone_id = o.pu_zone"""
VIEWS["zone_speeds"] = """
SELECT pu_zone, median(route_distance_m / free_flow_duration_s) AS zone_speed_ms FROM routes
WHERE free_flow_duration_s > 0 GROUP BY 1"""
VIEWS["matrix"] = """
SELECT pu_zone, do_zone,
       CAST(CASE WHEN broken THEN patch ELSE route_distance_m END AS FLOAT) AS route_distance_m,
       CAST(CASE WHEN broken THEN patch / GREATEST((SELECT median(zone_speed_ms) FROM zone_speeds), 1)
            ELSE free_flow_duration_s END AS FLOAT) AS free_flow_duration_s,
       turn_count, CAST(highway_fraction AS FLOAT) AS highway_fraction, FALSE AS is_intra_zone, broken AS is_estimated
FROM (SELECT r.*, r.route_distance_m <= 0 OR r.free_flow_duration_s <= 0 AS broken,
             (COALESCE(a.distance_m, 1000) + COALESCE(b.distance_m, 1000)) / 2 AS patch
      FROM routes r LEFT JOIN intra a ON r.pu_zone = a.pu_zone LEFT JOIN intra b ON r.do_zone = b.pu_zone)
UNION ALL
SELECT i.pu_zone, i.pu_zone, CAST(distance_m AS FLOAT),
       CAST(distance_m / GREATEST(COALESCE(zone_speed_ms, (SELECT median(zone_speed_ms) FROM zone_speeds)), 1) AS FLOAT),
       0, CAST(0 AS FLOAT), TRUE, TRUE
FROM intra i LEFT JOIN zone_speeds s ON i.pu_zone = s.pu_zone"""
VIEWS["detour"] = """
SELECT m.pu_zone, m.do_zone, COALESCE(o.n, 0) AS detour_trips,
       CAST(CASE WHEN o.n >= 30 THEN o.miles * CAST(1609.344 AS DOUBLE) / m.route_distance_m END AS FLOAT)
         AS structural_detour_ratio
FROM matrix m LEFT JOIN (SELECT pu_zone, do_zone, COUNT(*) AS n, median(trip_miles) AS miles FROM train
  WHERE trip_miles > 0 GROUP BY 1, 2) o ON m.pu_zone = o.pu_zone AND m.do_zone = o.do_zone"""
VIEWS["night"] = """
SELECT pu_zone AS zone_id, median(trip_miles * CAST(1609.344 AS DOUBLE) / trip_duration_s) AS night_speed_ms,
       COUNT(*) AS night_trips
FROM train WHERE (request_local_s % 86400) // 3600 IN (3, 4) AND trip_duration_s > 60 AND trip_miles > CAST(0.3 AS DOUBLE)
GROUP BY 1"""
VIEWS["routed"] = """
SELECT pu_zone AS zone_id, median(CAST(route_distance_m AS DOUBLE) / free_flow_duration_s) AS routed_speed_ms
FROM matrix WHERE NOT is_intra_zone AND free_flow_duration_s > 0 GROUP BY 1"""
VIEWS["history"] = f"""
SELECT zone_id, CAST(hist_mean_duration_s AS FLOAT) AS hist_mean_duration_s, COALESCE(hist_trips, 0) AS hist_trips,
       CAST(routed_speed_ms AS FLOAT) AS routed_speed_ms, COALESCE(night_trips, 0) AS night_trips,
       CAST(CASE WHEN COALESCE(night_trips, 0) >= {NIGHT_FLOOR} THEN night_speed_ms ELSE routed_speed_ms END AS FLOAT)
         AS reference_speed_ms,
       COALESCE(night_trips, 0) >= {NIGHT_FLOOR} AS reference_observed
FROM (SELECT pu_zone AS zone_id, AVG(total_time_s) AS hist_mean_duration_s, COUNT(*) AS hist_trips FROM train GROUP BY 1)
FULL JOIN routed USING (zone_id) FULL JOIN night USING (zone_id)"""


def rounded(*names: str, digits: int = 4) -> list[F.Column]:
    return [F.round(F.col(c).cast("double"), digits).alias(c) for c in names]


def sql_rounded(*names: str, digits: int = 4) -> str:
    return ", ".join(f"ROUND(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in names)


def intra(spark: SparkSession, sf: str) -> DataFrame:
    return ref.intra_zone_distances(d.enriched(spark, sf), d.zones(spark, sf), INTRA_FLOOR)


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The pair matrix, written once: a frozen artifact that the feature jobs look up."""
    return written_once(
        spark, sf, "matrix", lambda: ref.complete_matrix(d.routes(spark, sf), intra(spark, sf))
    )


def detour(spark: SparkSession, sf: str) -> DataFrame:
    return written_once(
        spark, sf, "detour", lambda: ref.detour_ratios(d.enriched(spark, sf), matrix(spark, sf))
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    return written_once(
        spark, sf, "history", lambda: ref.zone_history(d.enriched(spark, sf), matrix(spark, sf), NIGHT_FLOOR)
    )


def embeddings(spark: SparkSession, sf: str, dims: int = 4) -> DataFrame:
    return written_once(
        spark,
        sf,
        f"embeddings-{dims}",
        lambda: ref.zone_embeddings(d.split_trips(spark, sf), d.zones(spark, sf), dims),
    )


@query(
    "routes_from_json",
    "S9",
    """
SELECT event_id, CAST(value * 1000 AS DOUBLE) AS route_distance_m, CAST(60 + event_id % 900 AS DOUBLE) AS duration_s,
       1 + CAST(event_type IN ('click', 'view') AS INTEGER) AS turn_count,
       CASE WHEN value > 0 THEN ROUND(LEAST(1, (value * CAST(400 AS DOUBLE)
         + CASE WHEN event_type = 'error' THEN 0 ELSE user_id END) / (value * 1000)), 6) ELSE 0 END AS highway_fraction
FROM events WHERE event_id % 13 <> 0
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL FROM events WHERE event_id % 13 = 0""",
)
def routes_from_json(spark, sf):
    """Router answers built from events: no route, turns of several kinds, steps without classes."""
    payload = F.expr(
        """CASE WHEN event_id % 13 = 0 THEN '{"routes": []}' ELSE to_json(named_struct('routes', array(named_struct(
             'distance', value * 1000D, 'duration', 60 + event_id % 900, 'legs', array(named_struct('steps', array(
               named_struct('distance', value * 400D,
                 'maneuver', named_struct('type', 'on ramp', 'modifier', 'slight right'),
                 'intersections', array(named_struct('classes', array('toll', 'motorway')))),
               named_struct('distance', CAST(user_id AS DOUBLE),
                 'maneuver', named_struct('type', 'turn', 'modifier',
                    CASE WHEN event_type IN ('click', 'view') THEN 'left' ELSE 'straight' END),
                 'intersections', array(named_struct('classes', CAST(NULL AS ARRAY<STRING>)), named_struct('classes',
                    array(CASE WHEN event_type = 'error' THEN 'toll' ELSE 'motorway' END)))),
               named_struct('distance', 5D, 'maneuver', named_struct('type', 'depart', 'modifier', 'left'),
                 'intersections', array(named_struct('classes', CAST(NULL AS ARRAY<STRING>)))))))))))
           END"""
    )
    route = d.table(spark, sf, "events").select("event_id", parse_route(payload).alias("r"))
    return route.select(
        "event_id",
        "r.route_distance_m",
        F.col("r.free_flow_duration_s").alias("duration_s"),
        "r.turn_count",
        F.round("r.highway_fraction", 6).alias("highway_fraction"),
    )


@query(
    "intra_zone_distance",
    "A7",
    "SELECT pu_zone, ROUND(distance_m, 4) AS distance_m, CAST(from_observation AS INTEGER) AS from_observation FROM intra",
)
def intra_zone_distance(spark, sf):
    return intra(spark, sf).select(
        "pu_zone", *rounded("distance_m"), F.col("from_observation").cast("int").alias("from_observation")
    )


@query(
    "zone_pair_matrix",
    "A8 A9 J7 J8 N12",
    f"""SELECT pu_zone, do_zone, {sql_rounded('route_distance_m', 'free_flow_duration_s', digits=2)}, turn_count,
        ROUND(CAST(highway_fraction AS DOUBLE), 4) AS highway_fraction, CAST(is_intra_zone AS INTEGER) AS is_intra_zone,
        CAST(is_estimated AS INTEGER) AS is_estimated FROM matrix""",
)
def zone_pair_matrix(spark, sf):
    full = ref.complete_matrix(d.routes(spark, sf), intra(spark, sf))
    return full.select(
        "pu_zone",
        "do_zone",
        *rounded("route_distance_m", "free_flow_duration_s", digits=2),
        "turn_count",
        *rounded("highway_fraction"),
        F.col("is_intra_zone").cast("int").alias("is_intra_zone"),
        F.col("is_estimated").cast("int").alias("is_estimated"),
    )


@query(
    "matrix_validation",
    "F14",
    """SELECT COUNT(*) AS pairs, ABS(COUNT(*) - 625) AS missing_or_extra,
              COUNT(*) - COUNT(DISTINCT (pu_zone, do_zone)) AS duplicates,
              COUNT(*) FILTER (route_distance_m <= 0) AS bad_distance,
              COUNT(*) FILTER (free_flow_duration_s <= 0) AS bad_duration,
              COUNT(*) FILTER (NOT highway_fraction BETWEEN 0 AND 1) AS bad_highway_fraction,
              GREATEST(COUNT(*) FILTER (is_estimated) - 35, 0) AS estimates_over_limit FROM matrix""",
)
def matrix_validation(spark, sf):
    return ref.matrix_checks(matrix(spark, sf), d.zones(spark, sf).count())


@query(
    "zone_table_validation",
    "F15 P33",
    """
WITH used AS (SELECT DISTINCT z.* FROM trips t JOIN zones z ON t.pu_zone = z.zone_id)
SELECT COUNT(*) AS zones, CAST(COUNT(*) = 0 AS BIGINT) AS is_empty,
       COUNT(*) FILTER (NOT (centroid_lat BETWEEN 40.0 AND 41.2 AND centroid_lon BETWEEN -74.5 AND -73.5)) AS outside_box,
       COUNT(*) - COUNT(DISTINCT zone_id) AS duplicates,
       3 - COUNT(DISTINCT zone_id) FILTER (zone_id IN (3, 7, 138)) AS required_missing FROM used""",
)
def zone_table_validation(spark, sf):
    """Checks over the zones that trips actually start in."""
    used = d.trips(spark, sf).select(F.col("pu_zone").alias("zone_id")).distinct()
    zones = ref.zone_table(d.zones(spark, sf).join(used, "zone_id", "left_semi"), (3, 7))
    return ref.zone_checks(zones, (3, 7, 138))


@query(
    "detour_ratios",
    "A6",
    f"SELECT pu_zone, do_zone, {sql_rounded('structural_detour_ratio')}, detour_trips FROM detour",
)
def detour_ratios(spark, sf):
    found = ref.detour_ratios(d.enriched(spark, sf), matrix(spark, sf))
    return found.select("pu_zone", "do_zone", *rounded("structural_detour_ratio"), "detour_trips")


@query(
    "routed_zone_speed",
    "A3",
    """SELECT zone_id, ROUND(routed_speed_ms, 4) AS routed_speed_ms, trips FROM routed
       JOIN (SELECT pu_zone, COUNT(*) AS trips FROM clean GROUP BY 1) ON zone_id = pu_zone""",
)
def routed_zone_speed(spark, sf):
    used = cleaning.clean(d.trips(spark, sf)).groupBy(F.col("pu_zone").alias("zone_id")).agg(
        F.count("*").alias("trips")
    )
    return ref.routed_speed(matrix(spark, sf)).join(used, "zone_id").select(
        "zone_id", *rounded("routed_speed_ms"), "trips"
    )


@query("night_zone_speed", "A4", f"SELECT zone_id, {sql_rounded('night_speed_ms')}, night_trips FROM night")
def night_zone_speed(spark, sf):
    return ref.night_speed(d.split_trips(spark, sf)).select("zone_id", *rounded("night_speed_ms"), "night_trips")


@query(
    "zone_history",
    "A5 J6",
    f"""SELECT zone_id, {sql_rounded('hist_mean_duration_s', 'routed_speed_ms', 'reference_speed_ms', digits=3)},
        hist_trips, night_trips, CAST(reference_observed AS INTEGER) AS reference_observed FROM history""",
)
def zone_history(spark, sf):
    built = ref.zone_history(d.enriched(spark, sf), matrix(spark, sf), NIGHT_FLOOR)
    return built.select(
        "zone_id",
        *rounded("hist_mean_duration_s", "routed_speed_ms", "reference_speed_ms", digits=3),
        "hist_trips",
        "night_trips",
        F.col("reference_observed").cast("int").alias("reference_observed"),
    )


@query(
    "square_area_estimate",
    "P28",
    """SELECT t.pu_zone, COUNT(*) AS trips, ROUND(0.5214 * sqrt(MAX(z.area_km2)) * 1000, 4) AS distance_m,
       ROUND(0.5214 * sqrt(MAX(z.area_km2)) * 1000 / GREATEST(AVG(t.trip_miles * CAST(1609.344 AS DOUBLE)
         / t.trip_duration_s), 1), 4) AS duration_s
       FROM clean t JOIN zones z ON t.pu_zone = z.zone_id WHERE t.trip_duration_s > 0 GROUP BY 1""",
)
def square_area_estimate(spark, sf):
    speed = F.avg(F.col("trip_miles") * 1609.344 / F.col("trip_duration_s"))
    per_zone = (
        cleaning.clean(d.trips(spark, sf))
        .filter("trip_duration_s > 0")
        .groupBy("pu_zone")
        .agg(F.count("*").alias("trips"), speed.alias("speed"))
    )
    areas = d.zones(spark, sf).select(F.col("zone_id").alias("pu_zone"), "area_km2")
    distance, duration = ref.intra_zone_estimate(F.col("area_km2"), F.col("speed"))
    return per_zone.join(areas, "pu_zone").select(
        "pu_zone", "trips", F.round(distance, 4).alias("distance_m"), F.round(duration, 4).alias("duration_s")
    )


@query(
    "training_pair_counts",
    "A10",
    "SELECT pu_zone, do_zone, COUNT(*) AS trips FROM train GROUP BY 1, 2",
)
def training_pair_counts(spark, sf):
    return ref.pair_counts(d.enriched(spark, sf))


VIEWS["pair_cells"] = """
SELECT pu_zone AS zone_id, do_zone AS slot, ln(1 + COUNT(*)) AS w FROM train GROUP BY 1, 2
UNION ALL SELECT do_zone, pu_zone + 1000, ln(1 + COUNT(*)) FROM train GROUP BY 1, 2"""
VIEWS["centred_cells"] = """
SELECT z.zone_id, s.slot, COALESCE(c.w, 0) - AVG(COALESCE(c.w, 0)) OVER (PARTITION BY s.slot) AS x
FROM zones z CROSS JOIN (SELECT DISTINCT slot FROM pair_cells) s
LEFT JOIN pair_cells c ON c.zone_id = z.zone_id AND c.slot = s.slot"""


def full_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """As many dimensions as zones: products of these vectors are those of the centred trip-count rows themselves."""
    return embeddings(spark, sf, d.zones(spark, sf).count())


@query(
    "zone_embeddings",
    "A11",
    """SELECT a.zone_id, ROUND(SUM(a.x * a.x), 2) AS squared_norm, ROUND(SUM(a.x * b.x), 2) AS product_with_next
       FROM centred_cells a LEFT JOIN centred_cells b ON b.zone_id = a.zone_id + 1 AND b.slot = a.slot GROUP BY 1""",
)
def zone_embeddings(spark, sf):
    """Length of every zone's vector and its product with the next zone's; signs of single components are arbitrary."""
    found = full_embeddings(spark, sf)
    after = found.select((F.col("zone_id") - 1).alias("zone_id"), F.col("embedding").alias("next"))
    def product(a: str, b: str):
        terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), 2)

    joined = found.join(after, "zone_id", "left")
    return joined.select(
        "zone_id", product("embedding", "embedding").alias("squared_norm"), product("embedding", "next").alias("product_with_next")
    )


@query(
    "reference_coverage",
    "A34",
    """SELECT 'matrix' AS "table", COUNT(*) AS rows, COUNT(*) FILTER (NOT is_estimated) AS observed FROM matrix
       UNION ALL SELECT 'detour', COUNT(*), COUNT(structural_detour_ratio) FROM detour
       UNION ALL SELECT 'history', COUNT(*), COUNT(*) FILTER (reference_observed) FROM history""",
)
def reference_coverage(spark, sf):
    return ref.coverage_counts(matrix(spark, sf), detour(spark, sf), history(spark, sf))
