"""Fixed values. Results must agree on these, so they are stated here once, in plain text."""

from __future__ import annotations

LOCAL_TZ = "America/New_York"

# Trip file layout.
TRIP_TIMESTAMPS = ("request_datetime", "on_scene_datetime", "pickup_datetime", "dropoff_datetime")
TRIP_COLUMNS = (
    "hvfhs_license_num",
    "request_datetime",
    "on_scene_datetime",
    "pickup_datetime",
    "dropoff_datetime",
    "PULocationID",
    "DOLocationID",
    "trip_miles",
    "trip_time",
)

# Zones. Ids 264 and 265 mean "unknown" and "outside".
MAX_ROUTABLE_ZONE = 263
UNKNOWN_ZONES = (264, 265)
MAX_ZONE_ID = 265
BOROUGH_IDS = {
    "Manhattan": 1,
    "Brooklyn": 2,
    "Queens": 3,
    "Bronx": 4,
    "Staten Island": 5,
    "EWR": 6,
}

# Cleaning limits.
MAX_TRIP_S = 21_600
MAX_DISPATCH_S = 7_200
MAX_MPH = 80

# Units.
METRES_PER_MILE = 1609.344
EARTH_RADIUS_KM = 6371.0088
MEAN_DISTANCE_IN_SQUARE = 0.5214

# Weather stations (latitude, longitude) in tie-break order, and sentinels for "missing".
STATION_COORDS = {
    "central_park": (40.7794, -73.9692),
    "lga": (40.7794, -73.8803),
    "jfk": (40.6386, -73.7622),
    "ewr": (40.6825, -74.1694),
}
MISSING_TEMP = 9999
MISSING_WIND = 9999
MISSING_VISIBILITY = 999999
MISSING_PRECIP = 9999
WEATHER_COLUMNS = ("temp_c", "wind_ms", "visibility_m", "precip_mm_h", "snow_depth_cm")

# Segments and splits, in reporting order.
SEGMENT_COLUMNS = ("seg_time", "seg_trip_length", "seg_zone_density", "seg_weather")
REQUEST_TIME_SEGMENTS = ("seg_time", "seg_zone_density", "seg_weather")
SEGMENT_BUCKETS = {
    "seg_time": ("peak_am", "peak_pm", "off_peak", "late_night"),
    "seg_trip_length": ("short", "medium", "long"),
    "seg_zone_density": ("manhattan_core", "outer_borough", "airport"),
    "seg_weather": ("clear", "rain", "snow"),
}
SPLITS = ("train", "cal", "val", "test", "holdout", "beyond")

# Column roles. A feature may not read a column that is only known after the trip.
POST_HOC_COLUMNS = frozenset(
    {
        "on_scene_datetime",
        "pickup_datetime",
        "dropoff_datetime",
        "trip_miles",
        "trip_time",
        "total_time_s",
        "dispatch_approach_s",
        "curb_wait_s",
        "trip_duration_s",
    }
)
EVAL_ONLY_COLUMNS = frozenset({"seg_trip_length"})

TARGET = "total_time_s"
COMPONENTS = ("dispatch_approach_s", "curb_wait_s", "trip_duration_s")

# US holidays used by the holiday feature.
HOLIDAYS = (
    "2023-01-01",
    "2023-01-16",
    "2023-02-20",
    "2023-05-29",
    "2023-06-19",
    "2023-07-04",
    "2023-09-04",
    "2023-10-09",
    "2023-11-10",
    "2023-11-23",
    "2023-12-25",
    "2024-01-01",
    "2024-01-15",
    "2024-02-19",
)
FEATURE_EPOCH = "2023-01-01"

# Route JSON.
TURN_KINDS = (
    "turn",
    "fork",
    "merge",
    "on ramp",
    "off ramp",
    "end of road",
    "roundabout",
    "rotary",
    "roundabout turn",
)
MOTORWAY = "motorway"

# Congestion state.
BUCKET_S = 300
WINDOWS_MIN = (15, 30, 60)
STATE_MEASURES = ("completed", "distance_m", "duration_s")

# Observation floors.
MIN_NIGHT_TRIPS = 200
NIGHT_HOURS = (3, 4)
MIN_DETOUR_TRIPS = 30
MIN_INTRA_ZONE_TRIPS = 200
DEFAULT_INTRA_ZONE_M = 1000.0
MIN_PAIR_ROWS = 30
MIN_HOUR_ROWS = 100
MIN_SEGMENT_ROWS = 1_000

# Sampling tiers in basis points of the key hash.
HASH_MODULUS = 10_000
TIERS = {"tune": 300, "ablation": 2_500, "full": 10_000}

# Fixed: columns of the pair matrix.
MATRIX_COLUMNS = (
    "pu_zone",
    "do_zone",
    "route_distance_m",
    "free_flow_duration_s",
    "turn_count",
    "highway_fraction",
    "is_intra_zone",
    "is_estimated",
)
