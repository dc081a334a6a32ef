"""DuckDB views with the same content as ``sources.driver_tables``, written independently as SQL."""

from __future__ import annotations

import math
import re

from tripspark.vocab import STATION_COORDS

BUCKET = "CAST(FLOOR({0} / 300.0) AS BIGINT) * 300"


def _hour(col: str) -> str:
    return f"(({col} % 86400) // 3600)"


VIEWS: dict[str, str] = {
    "src": """
SELECT l.l_orderkey AS ok, CAST(l.l_linenumber AS BIGINT) AS ln, l.l_partkey AS pk, l.l_suppkey AS sk,
       l.l_quantity AS qty, l.l_linestatus AS ls, CAST(FLOOR(l.l_extendedprice) AS BIGINT) AS px,
       CAST(date_diff('day', DATE '1970-01-01', CAST(o.o_orderdate AS DATE)) AS BIGINT) AS day,
       CAST(c.c_nationkey AS BIGINT) + 1 AS pu, CAST(s.s_nationkey AS BIGINT) + 1 AS dz,
       (l.l_orderkey * 7919 + l.l_partkey * 104729 + l.l_linenumber * 1299709) % 86400 AS sod
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey""",
    "timed": """
SELECT *, day * 86400 + sod AS request_s, 60 + (sk * 37 + pk * 11) % 900 AS d, 10 + (ln * 53 + ok) % 180 AS w,
       180 + px % 4000 + CASE WHEN sod BETWEEN 57600 AND 71999 THEN 600 ELSE 0 END AS r FROM src""",
    "trips": """
SELECT (ok * 8 + ln) * 4000000 + (pk % 2000) * 2000 + sk % 2000 AS trip_id,
       CASE WHEN ls = 'O' THEN 'HV0003' ELSE 'HV0005' END AS operator,
       request_s, request_s AS request_local_s,
       CASE WHEN ls = 'O' THEN request_s + d END AS on_scene_s,
       CASE WHEN (ok + pk) % 203 = 0 THEN request_s - 60 ELSE request_s + d + w END AS pickup_s,
       CASE WHEN (ok + pk) % 501 = 0 THEN NULL WHEN (ok + pk) % 307 = 0 THEN request_s + 30000
            ELSE request_s + d + w + r END AS dropoff_s,
       CASE WHEN (ok + pk) % 97 = 0 THEN 264 ELSE pu END AS pu_zone, dz AS do_zone,
       CASE WHEN (ok + pk) % 331 = 0 THEN CAST(0 AS DOUBLE) WHEN (ok + pk) % 401 = 0 THEN qty * CAST(10 AS DOUBLE)
            ELSE qty * CAST(0.3 AS DOUBLE) END AS trip_miles,
       r AS trip_time
FROM timed""",
    "ruled": """
SELECT *,
       COALESCE(request_s IS NOT NULL AND pickup_s IS NOT NULL AND dropoff_s IS NOT NULL, FALSE) AS k1,
       COALESCE(request_s <= pickup_s AND pickup_s <= dropoff_s, FALSE) AS k2,
       COALESCE(dropoff_s - request_s > 0, FALSE) AS k3,
       COALESCE(dropoff_s - request_s <= 21600, FALSE) AS k4,
       COALESCE(pickup_s - request_s <= 7200, FALSE) AS k5,
       COALESCE(NOT (trip_miles <= 0 AND trip_time > 0), FALSE) AS k6,
       COALESCE(trip_time <= 0 OR trip_miles * 3600 <= 80 * trip_time, FALSE) AS k7,
       COALESCE(pu_zone BETWEEN 1 AND 263 AND do_zone BETWEEN 1 AND 263, FALSE) AS k8
FROM trips""",
    "clean": """
SELECT trip_id, operator, request_s, request_local_s, on_scene_s, pickup_s, dropoff_s, pu_zone, do_zone,
       trip_miles, trip_time, dropoff_s - request_s AS total_time_s, on_scene_s - request_s AS dispatch_approach_s,
       pickup_s - on_scene_s AS curb_wait_s, dropoff_s - pickup_s AS trip_duration_s
FROM ruled WHERE k1 AND k2 AND k3 AND k4 AND k5 AND k6 AND k7 AND k8""",
    "zones": """
SELECT CAST(n_nationkey AS BIGINT) + 1 AS zone_id,
       CASE r_name WHEN 'AFRICA' THEN 'Manhattan' WHEN 'AMERICA' THEN 'Brooklyn' WHEN 'ASIA' THEN 'Queens'
                   WHEN 'EUROPE' THEN 'Bronx' WHEN 'MIDDLE EAST' THEN 'Staten Island' END AS borough,
       n_name AS zone_name,
       CAST(0.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * CAST(n_nationkey AS DOUBLE) AS area_km2,
       CAST(40.5 AS DOUBLE) + CAST(0.02 AS DOUBLE) * CAST(n_nationkey AS DOUBLE) AS centroid_lat,
       CAST(-74.3 AS DOUBLE) + CAST(0.024 AS DOUBLE) * CAST(n_nationkey AS DOUBLE) AS centroid_lon,
       n_nationkey IN (2, 6) AS is_airport
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "density": """
SELECT zone_id, CASE WHEN zone_id IN (3, 7) THEN 'airport' WHEN borough = 'Manhattan' THEN 'manhattan_core'
                     ELSE 'outer_borough' END AS seg_zone_density FROM zones""",
    "split_trips": f"""
SELECT c.*,
       CASE WHEN request_local_s < epoch(TIMESTAMP '1995-01-01') THEN 'beyond'
            WHEN request_local_s < epoch(TIMESTAMP '1999-01-01') THEN 'train'
            WHEN request_local_s < epoch(TIMESTAMP '2000-01-01') THEN 'cal'
            WHEN request_local_s < epoch(TIMESTAMP '2000-07-01') THEN 'val'
            WHEN request_local_s < epoch(TIMESTAMP '2001-01-01') THEN 'test'
            WHEN request_local_s < epoch(TIMESTAMP '2001-02-26') THEN 'holdout' ELSE 'beyond' END AS split,
       CASE WHEN {_hour('request_local_s')} >= 23 OR {_hour('request_local_s')} < 5 THEN 'late_night'
            WHEN {_hour('request_local_s')} BETWEEN 6 AND 9 THEN 'peak_am'
            WHEN {_hour('request_local_s')} BETWEEN 16 AND 19 THEN 'peak_pm' ELSE 'off_peak' END AS seg_time,
       CASE WHEN trip_miles < 2 THEN 'short' WHEN trip_miles > 8 THEN 'long'
            WHEN trip_miles IS NOT NULL THEN 'medium' END AS seg_trip_length,
       d.seg_zone_density
FROM clean c LEFT JOIN density d ON c.pu_zone = d.zone_id""",
    "state_buckets": f"""
SELECT pu_zone AS zone, {BUCKET.format('dropoff_s')} AS bucket_s, COUNT(*) AS completed,
       COALESCE(SUM(trip_miles * CAST(1609.344 AS DOUBLE)), 0) AS distance_m, SUM(trip_duration_s) AS duration_s
FROM clean WHERE trip_duration_s > 0 GROUP BY 1, 2""",
    "completions": """
SELECT user_id % 25 + 1 AS zone, CAST(FLOOR(FLOOR(epoch(ts)) / 300) AS BIGINT) * 300 AS bucket_s,
       COUNT(*) AS completed, ROUND(SUM(value * 100), 6) AS distance_m, SUM(60 + event_id % 900) AS duration_s
FROM events GROUP BY 1, 2""",
    "requests": """
SELECT event_id AS request_id, (user_id * 7) % 25 + 1 AS pu_zone, CAST(FLOOR(epoch(ts)) AS BIGINT) + 137 AS request_s
FROM events""",
    "routes": """
SELECT pu_zone, do_zone,
       CASE WHEN pu_zone = 3 AND do_zone = 9 THEN 0 ELSE CAST(500 + 900 * ABS(pu_zone - do_zone) AS DOUBLE) END
         AS route_distance_m,
       CASE WHEN pu_zone = 4 AND do_zone = 11 THEN 0
            ELSE CAST(60 + 70 * ABS(pu_zone - do_zone) + 3 * (pu_zone % 5) AS DOUBLE) END AS free_flow_duration_s,
       CAST(ABS(pu_zone - do_zone) % 17 AS INTEGER) AS turn_count,
       LEAST(CAST(1 AS DOUBLE), ABS(pu_zone - do_zone) / CAST(20 AS DOUBLE)) AS highway_fraction,
       FALSE AS is_intra_zone
FROM (SELECT DISTINCT pu_zone, do_zone FROM trips WHERE pu_zone <= 263 AND pu_zone <> do_zone)""",
    "weather_reports": """
SELECT (['central_park', 'lga', 'jfk', 'ewr'])[o_orderkey % 4 + 1] AS station,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || 'T' || lpad(CAST(o_orderkey * 7 % 24 AS VARCHAR), 2, '0') || ':'
         || lpad(CAST(o_orderkey * 11 % 60 AS VARCHAR), 2, '0') || ':00' AS stamp,
       CASE WHEN o_orderkey % 29 = 0 THEN '+9999,9' ELSE printf('%+05d,1', o_orderkey * 37 % 420 - 100) END AS TMP,
       CASE WHEN o_orderkey % 31 = 0 THEN '180,1,N,9999,9'
            ELSE printf('180,1,N,%04d,1', o_orderkey * 13 % 150) END AS WND,
       CASE WHEN o_orderkey % 37 = 0 THEN '999999,9,9,9' ELSE printf('%06d,1,9,9', o_orderkey * 17 % 16000) END AS VIS,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN '01,9999,9,9'
            ELSE printf('%02d,%04d,9,5', o_orderkey * 5 % 26, o_orderkey * 19 % 80) END AS AA1,
       CASE WHEN o_orderkey % 5 = 0 THEN printf('%04d,1,9', o_orderkey * 23 % 700) END AS AJ1
FROM orders""",
    "scored_all": """
SELECT *, CAST(total_time_s AS DOUBLE) AS actual,
       900 + off - CASE WHEN trip_id % 11 = 1 THEN 700 ELSE 0 END AS q1,
       2700 + off - CASE WHEN trip_id % 11 = 2 THEN 700 ELSE 0 END AS q2,
       3700 + off - CASE WHEN trip_id % 11 = 3 THEN 700 ELSE 0 END AS q3,
       4300 + off - CASE WHEN trip_id % 11 = 4 THEN 700 ELSE 0 END AS q4,
       4500 + off - CASE WHEN trip_id % 11 = 5 THEN 700 ELSE 0 END AS q5,
       CAST(2600 + 40 * ABS(pu_zone - do_zone) + 5 * (trip_id % 3) AS DOUBLE) AS baseline
FROM (SELECT *, CAST(15 * (pu_zone % 5) + 10 * (trip_id % 7) AS DOUBLE) AS off FROM enriched)""",
    "scored": "SELECT * FROM scored_all WHERE split = 'test'",
}

VIEWS["weather_parsed"] = """
SELECT station, CAST(FLOOR(epoch(CAST(stamp AS TIMESTAMP)) / 3600) AS BIGINT) * 3600 AS hour_s,
  CASE WHEN ABS(TRY_CAST(string_split(TMP, ',')[1] AS INT)) <> 9999
       THEN TRY_CAST(string_split(TMP, ',')[1] AS INT) / CAST(10 AS DOUBLE) END AS temp_c,
  CASE WHEN TRY_CAST(string_split(WND, ',')[4] AS INT) <> 9999
       THEN TRY_CAST(string_split(WND, ',')[4] AS INT) / CAST(10 AS DOUBLE) END AS wind_ms,
  CASE WHEN TRY_CAST(string_split(VIS, ',')[1] AS INT) <> 999999
       THEN CAST(TRY_CAST(string_split(VIS, ',')[1] AS INT) AS DOUBLE) END AS visibility_m,
  CASE WHEN TRY_CAST(string_split(AA1, ',')[2] AS INT) <> 9999 AND TRY_CAST(string_split(AA1, ',')[1] AS INT) > 0
            AND TRY_CAST(string_split(AA1, ',')[1] AS INT) < 24
       THEN TRY_CAST(string_split(AA1, ',')[2] AS INT) / CAST(10 AS DOUBLE)
            / TRY_CAST(string_split(AA1, ',')[1] AS INT) END AS precip_mm_h,
  CASE WHEN TRY_CAST(string_split(AJ1, ',')[1] AS INT) BETWEEN 0 AND 500
       THEN CAST(TRY_CAST(string_split(AJ1, ',')[1] AS INT) AS DOUBLE) END AS snow_depth_cm
FROM weather_reports"""
VIEWS["weather_hours"] = """
SELECT station, hour_s, AVG(temp_c) AS temp_c, AVG(wind_ms) AS wind_ms, MIN(visibility_m) AS visibility_m,
       MAX(precip_mm_h) AS precip_mm_h, MAX(snow_depth_cm) AS snow_depth_cm
FROM weather_parsed GROUP BY 1, 2"""
VIEWS["weather_grid"] = """
SELECT s.station, h.hour_s FROM (SELECT DISTINCT station FROM weather_parsed) s,
       (SELECT unnest(generate_series(MIN(hour_s), MAX(hour_s), 3600)) AS hour_s FROM weather_parsed) h"""
VIEWS["weather_filled"] = (
    "SELECT g.station, g.hour_s, "
    + ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY g.station ORDER BY g.hour_s "
        f"ROWS BETWEEN {n} PRECEDING AND CURRENT ROW) AS {c}"
        for c, n in (("temp_c", 2), ("wind_ms", 2), ("visibility_m", 2), ("snow_depth_cm", 24))
    )
    + """, COALESCE(precip_mm_h, 0) AS precip_mm_h FROM weather_grid g
LEFT JOIN weather_hours o ON g.station = o.station AND g.hour_s = o.hour_s"""
)
_KM = " ".join(
    f"""2 * 6371.0088 * asin(sqrt(pow(sin((radians(centroid_lat) - radians(CAST({lat} AS DOUBLE))) / 2), 2)
    + cos(radians(centroid_lat)) * cos(radians(CAST({lat} AS DOUBLE)))
    * pow(sin((radians(centroid_lon) - radians(CAST({lon} AS DOUBLE))) / 2), 2))) AS km_{i},"""
    for i, (lat, lon) in enumerate(STATION_COORDS.values())
)
VIEWS["zone_stations"] = f"""
SELECT zone_id, LEAST(km_0, km_1, km_2, km_3) AS km,
       CASE LEAST(km_0, km_1, km_2, km_3) WHEN km_0 THEN 'central_park' WHEN km_1 THEN 'lga' WHEN km_2 THEN 'jfk'
            ELSE 'ewr' END AS station
FROM (SELECT {_KM} zone_id FROM zones)"""
VIEWS["enriched"] = """
SELECT t.*, CAST(w.temp_c AS FLOAT) AS temp_c, CAST(w.wind_ms AS FLOAT) AS wind_ms,
       CAST(w.visibility_m AS FLOAT) AS visibility_m, CAST(w.precip_mm_h AS FLOAT) AS precip_mm_h,
       CAST(w.snow_depth_cm AS FLOAT) AS snow_depth_cm,
       CASE WHEN CAST(w.temp_c AS FLOAT) <= 0 AND COALESCE(CAST(w.precip_mm_h AS FLOAT), 0) >= CAST(0.5 AS DOUBLE)
              THEN 'snow'
            WHEN COALESCE(CAST(w.precip_mm_h AS FLOAT), 0) >= CAST(0.2 AS DOUBLE) THEN 'rain' ELSE 'clear' END
         AS seg_weather,
       CASE WHEN t.split = 'holdout' THEN CAST(LEAST(255, GREATEST(0,
         (t.request_local_s // 86400 - date_diff('day', DATE '1970-01-01', DATE '2001-01-01')) // 7)) AS SMALLINT) END
         AS holdout_week
FROM split_trips t LEFT JOIN zone_stations z ON t.pu_zone = z.zone_id
LEFT JOIN weather_filled w ON w.station = z.station AND w.hour_s = (t.request_s // 3600) * 3600"""



ROLLING = ",\n".join(
    f"SUM({m}) OVER (PARTITION BY zone ORDER BY bucket_s RANGE BETWEEN {60 * w - 1} PRECEDING AND CURRENT ROW) AS {m}_{w}m"
    for w in (15, 30, 60)
    for m in ("completed", "distance_m", "duration_s")
)
VIEWS["zone_state"] = f"SELECT *, {ROLLING} FROM state_buckets"
PI2 = repr(2 * math.pi)


def _needs(sql: str) -> list[str]:
    return [name for name in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql)]


def with_views(sql: str) -> str:
    """Put the WITH clause for every view the query reads, in dependency order, before it."""
    wanted: set[str] = set()
    stack = _needs(sql)
    while stack:
        name = stack.pop()
        if name not in wanted:
            wanted.add(name)
            stack += [n for n in _needs(VIEWS[name]) if n != name]
    if not wanted:
        return sql.strip()
    ordered: list[str] = []

    def place(name: str) -> None:
        if name not in ordered:
            for other in _needs(VIEWS[name]):
                if other != name:
                    place(other)
            ordered.append(name)

    for name in VIEWS:
        if name in wanted:
            place(name)
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in ordered]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        return "WITH " + ",\n".join(parts) + ",\n" + body
    return "WITH " + ",\n".join(parts) + "\n" + body
