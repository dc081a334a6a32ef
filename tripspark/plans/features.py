"""Queries for the feature registry, the lookups and the model matrix."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripspark.functions import vectors
from tripspark.operators import dataset, features, zone_state
from tripspark.plans import reference
from tripspark.plans.catalog import query
from tripspark.plans.oracle import VIEWS
from tripspark.session import fresh_path, written_once
from tripspark.sources import driver_tables as d
from tripspark.vocab import HOLIDAYS, MAX_ZONE_ID, WINDOWS_MIN, WEATHER_COLUMNS

KEY = ("trip_id", "pu_zone")


def static_tables(spark: SparkSession, sf: str) -> features.StaticTables:
    return features.StaticTables(
        zones=d.zones(spark, sf),
        matrix=reference.matrix(spark, sf),
        detour=reference.detour(spark, sf),
        embeddings=reference.embeddings(spark, sf),
        history=reference.history(spark, sf),
    )


def model_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Written once, without another shuffle; the model and scoring jobs start from it."""
    return written_once(
        spark,
        sf,
        "model-matrix",
        lambda: dataset.model_matrix(d.enriched(spark, sf), static_tables(spark, sf), "full", KEY),
    )


_HOUR = "((t.request_local_s % 86400) // 3600)"
_MINUTE = "((t.request_local_s % 3600) // 60)"
_DOW = "((t.request_local_s // 86400 + 3) % 7)"
_MONTH = "(month(make_timestamp(t.request_local_s * 1000000)) - 1)"
_BID = "CASE {0}.borough " + " ".join(
    f"WHEN '{b}' THEN {i}" for b, i in features.BOROUGH_IDS.items()
) + " ELSE 0 END"


def _cyc(name: str, value: str, period: int) -> str:
    return ", ".join(f"{fn}(({value}) * (2 * pi() / {period})) AS {name}_{fn}" for fn in ("sin", "cos"))


_CONGESTION = ", ".join(
    f"""(s.distance_m_{w}m / GREATEST(s.duration_s_{w}m, 1)) / GREATEST(hp.reference_speed_ms, CAST(0.1 AS DOUBLE))
         AS zone_speed_ratio_{w}m,
       CAST(s.completed_{w}m AS DOUBLE) AS zone_completed_trips_{w}m,
       s.completed_{w}m / GREATEST(zp.area_km2, CAST(0.01 AS DOUBLE)) AS zone_trip_density_{w}m,
       CAST(s.duration_s_{w}m AS DOUBLE) / GREATEST(s.completed_{w}m, 1) AS zone_mean_trip_duration_{w}m"""
    for w in WINDOWS_MIN
)
VIEWS["featured"] = f"""
SELECT t.trip_id, t.split, t.total_time_s, m.route_distance_m, m.free_flow_duration_s, m.turn_count, m.highway_fraction,
       e.structural_detour_ratio, t.pu_zone = t.do_zone AS is_intra_zone,
       m.route_distance_m / GREATEST(m.free_flow_duration_s, 1) AS route_free_flow_speed_ms,
       ln(1 + COALESCE(e.detour_trips, 0)) AS detour_confidence,
       {_cyc('hour', f'{_HOUR} + {_MINUTE} / CAST(60 AS DOUBLE)', 24)}, {_cyc('dow', _DOW, 7)}, {_cyc('month', _MONTH, 12)},
       {_HOUR} * 60 + {_MINUTE} AS minute_of_day, {_DOW} >= 5 AS is_weekend,
       strftime(make_timestamp(t.request_local_s * 1000000), '%Y-%m-%d') IN ({", ".join(f"'{h}'" for h in HOLIDAYS)})
         AS is_holiday,
       t.request_local_s // 86400 - date_diff('day', DATE '1970-01-01', DATE '2023-01-01') AS days_since_epoch,
       {_CONGESTION},
       zp.area_km2 AS pu_area_km2, zp.is_airport AS pu_is_airport, hp.hist_mean_duration_s AS pu_hist_mean_duration_s,
       zd.area_km2 AS do_area_km2, zd.is_airport AS do_is_airport, hd.hist_mean_duration_s AS do_hist_mean_duration_s,
       {_BID.format('zp')} = {_BID.format('zd')} AS same_borough,
       t.temp_c, t.wind_ms, t.visibility_m, t.precip_mm_h, t.snow_depth_cm,
       COALESCE(t.precip_mm_h, 0) * CAST({_HOUR} BETWEEN 16 AND 19 AS INTEGER) AS precip_x_peak
FROM (SELECT *, CAST(FLOOR(request_s / 300.0) AS BIGINT) * 300 AS key_s FROM enriched
      WHERE split IN ('train', 'cal', 'val', 'test')) t
ASOF LEFT JOIN zone_state s ON t.pu_zone = s.zone AND t.key_s > s.bucket_s
LEFT JOIN matrix m ON t.pu_zone = m.pu_zone AND t.do_zone = m.do_zone
LEFT JOIN detour e ON t.pu_zone = e.pu_zone AND t.do_zone = e.do_zone
LEFT JOIN zones zp ON t.pu_zone = zp.zone_id LEFT JOIN zones zd ON t.do_zone = zd.zone_id
LEFT JOIN history hp ON t.pu_zone = hp.zone_id LEFT JOIN history hd ON t.do_zone = hd.zone_id"""

_BOOLS = ("is_intra_zone", "is_weekend", "is_holiday", "pu_is_airport", "do_is_airport", "same_borough")


def _family(spark: SparkSession, sf: str, family: str) -> list[str]:
    skipped = {"zone_embedding_similarity"}
    return [f.name for f in features.default_registry().family(family) if f.name not in skipped]


def _shown(names: list[str]) -> list[F.Column]:
    return [
        F.col(n).cast("int").alias(n) if n in _BOOLS or n == "turn_count" else F.round(F.col(n).cast("double"), 3).alias(n)
        for n in names
    ]


def _shown_sql(names: list[str]) -> str:
    return ", ".join(
        f"CAST({n} AS INTEGER) AS {n}"
        if n in _BOOLS or n == "turn_count"
        else f"ROUND(CAST(CAST({n} AS FLOAT) AS DOUBLE), 3) AS {n}"
        for n in names
    )


# Registration needs a session for column expressions, so the names are spelled out from the same parts.
_NAMES = {
    "route": [
        "route_distance_m", "free_flow_duration_s", "turn_count", "highway_fraction", "structural_detour_ratio",
        "is_intra_zone", "route_free_flow_speed_ms", "detour_confidence",
    ],
    "temporal": [
        *[f"{n}_{fn}" for n in ("hour", "dow", "month") for fn in ("sin", "cos")],
        "minute_of_day", "is_weekend", "is_holiday", "days_since_epoch",
    ],
    "congestion": [
        f"zone_{n}_{w}m" for w in WINDOWS_MIN
        for n in ("speed_ratio", "completed_trips", "trip_density", "mean_trip_duration")
    ],
    "zone": [
        *[f"{s}_{n}" for s in ("pu", "do") for n in ("area_km2", "is_airport", "hist_mean_duration_s")], "same_borough",
    ],
    "weather": [*WEATHER_COLUMNS, "precip_x_peak"],
}

for _name, _covers in (
    ("route", "R1 R2 R3 R4 J3 J4b"),
    ("temporal", "P16 P17 T1 T2 T3 T4 T5"),
    ("congestion", "C1 C2 C3 C4"),
    ("zone", "Z1 Z2 J4"),
    ("weather", "W1 W2"),
):

    def _run(spark, sf, family=_name):
        names = _family(spark, sf, family)
        built = dataset.model_matrix(d.enriched(spark, sf), static_tables(spark, sf), "full", KEY, names=names)
        return built.select("trip_id", *_shown(names))

    query(f"{_name}_features", _covers, f"SELECT trip_id, {_shown_sql(_NAMES[_name])} FROM featured")(_run)


@query(
    "embedding_similarity_feature",
    "Z3",
    """
WITH p AS (SELECT a.zone_id AS pu_zone, b.zone_id AS do_zone, SUM(a.x * b.x) AS ab, SUM(a.x * a.x) AS aa, SUM(b.x * b.x) AS bb
           FROM centred_cells a JOIN centred_cells b ON a.slot = b.slot GROUP BY 1, 2)
SELECT t.trip_id, ROUND(CAST(CAST(ab / (sqrt(aa) * sqrt(bb)) AS FLOAT) AS DOUBLE), 2) AS similarity
FROM enriched t LEFT JOIN p ON t.pu_zone = p.pu_zone AND t.do_zone = p.do_zone WHERE split IN ('train', 'cal', 'val', 'test')""",
)
def embedding_similarity_feature(spark, sf):
    """The similarity of pickup and drop-off zone, with vectors of full rank so that SQL can say what it must be."""
    tables = replace(static_tables(spark, sf), embeddings=reference.full_embeddings(spark, sf))
    names = ["zone_embedding_similarity"]
    built = dataset.model_matrix(d.enriched(spark, sf), tables, "full", KEY, names=names)
    return built.select("trip_id", F.round(F.col("zone_embedding_similarity").cast("double"), 2).alias("similarity"))


@query(
    "cosine_similarity",
    "P27",
    """
WITH parts AS (SELECT label, i, AVG(CAST(embedding[i] AS DOUBLE)) AS part
               FROM (SELECT label, embedding, UNNEST(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2),
q AS (SELECT label, list(part ORDER BY i) AS centre FROM parts GROUP BY 1),
x AS (SELECT e.vec_id, CAST(embedding AS DOUBLE[]) AS v, q.centre FROM embeddings e JOIN q ON e.label = q.label)
SELECT vec_id, ROUND(list_dot_product(v, centre) / NULLIF(sqrt(list_dot_product(v, v))
       * sqrt(list_dot_product(centre, centre)), 0), 6) AS similarity FROM x""",
)
def cosine_similarity(spark, sf):
    """Each vector against the mean of its label."""
    vecs = d.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    parts = vecs.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("part"))
    # As many parts per label as a vector is long.
    centres = parts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "part"))).alias("c"))
    joined = vecs.join(centres.select("label", F.col("c.part").alias("centre")), "label")
    return joined.select("vec_id", F.round(vectors.cosine(F.col("v"), F.col("centre")), 6).alias("similarity"))


@query(
    "feature_matrix_by_split",
    "M14 N13 F17",
    """SELECT split, COUNT(*) AS rows, CAST(SUM(total_time_s) AS BIGINT) AS total_s, COUNT(structural_detour_ratio) AS with_detour,
              ROUND(AVG(CAST(zone_completed_trips_60m AS DOUBLE)), 4) AS mean_load,
              COUNT(*) FILTER (is_weekend) AS weekend_rows
       FROM featured WHERE split = 'val' GROUP BY 1""",
)
def feature_matrix_by_split(spark, sf):
    path = fresh_path(spark, "matrix-by-split")
    dataset.write_model_matrix(
        dataset.model_matrix(d.enriched(spark, sf), static_tables(spark, sf), "full", KEY), path
    )
    return dataset.load_split(spark, path, "val").groupBy("split").agg(
        F.count("*").alias("rows"),
        F.sum("total_time_s").alias("total_s"),
        F.count("structural_detour_ratio").alias("with_detour"),
        F.round(F.avg(F.col("zone_completed_trips_60m").cast("double")), 4).alias("mean_load"),
        F.count_if("is_weekend").alias("weekend_rows"),
    )


_DIGEST_PARTS = ["COUNT(*)"] + [
    f"{fn}({k})" for k in ("request_s", "pu_zone", "do_zone") for fn in ("SUM", "MIN", "MAX")
] + [
    """SUM(CAST('0x' || substr(md5(CAST(request_s AS VARCHAR) || '|' || CAST(pu_zone AS VARCHAR) || '|'
       || CAST(do_zone AS VARCHAR)), 1, 8) AS BIGINT))"""
]


@query(
    "population_digest",
    "A21",
    f"""SELECT COUNT(*) AS rows, substr(sha256({" || ';' || ".join(f"CAST({p} AS VARCHAR)" for p in _DIGEST_PARTS)}), 1, 16)
        AS digest FROM enriched WHERE split = 'test'""",
)
def population_digest(spark, sf):
    return dataset.population_digest(d.enriched(spark, sf).filter("split = 'test'"))


@query(
    "leakage_boundary",
    "F16",
    "SELECT CAST(44 AS BIGINT) AS features, CAST(0 AS BIGINT) AS post_hoc, COUNT(*) AS rows FROM featured",
)
def leakage_boundary(spark, sf):
    """Features and late columns among them, over the model rows; the check raises if a feature leaks."""
    registry = features.default_registry()
    enriched = d.enriched(spark, sf)
    assembled = features.assemble(enriched, static_tables(spark, sf), zone_state.zone_state(enriched))
    features.check_no_leakage(assembled, registry)
    leaked = len(features.LATE_COLUMNS.intersection(registry.names))
    return model_matrix(spark, sf).agg(F.count("*").alias("rows")).select(
        F.lit(len(registry)).cast("bigint").alias("features"), F.lit(leaked).cast("bigint").alias("post_hoc"), "rows"
    )


@query(
    "valid_and_rejected_requests",
    "F18 P32",
    f"""SELECT user_id AS pu_zone,
          CAST(user_id BETWEEN 1 AND {MAX_ZONE_ID} AND event_id % 300 BETWEEN 1 AND {MAX_ZONE_ID} AS INTEGER) AS is_valid,
          COUNT(*) AS requests,
          CAST(SUM(COALESCE(CASE WHEN event_id % 4 > 0 THEN CAST(FLOOR(epoch(ts)) AS BIGINT) END, 0)) AS BIGINT) AS total_s
        FROM events GROUP BY 1, 2""",
)
def valid_and_rejected_requests(spark, sf):
    from tripspark.functions import clock
    from tripspark.streaming.scoring import split_requests

    events = d.table(spark, sf, "events")
    asked = events.select(
        F.col("user_id").alias("pu_zone"),
        (F.col("event_id") % 300).alias("do_zone"),
        F.when(F.col("event_id") % 4 > 0, clock.ntz_seconds(F.col("ts"))).alias("request_s"),
    )
    valid, rejected = split_requests(asked, now_s=F.lit(0).cast("bigint"))
    both = valid.withColumn("is_valid", F.lit(1)).unionByName(rejected.withColumn("is_valid", F.lit(0)))
    return both.groupBy("pu_zone", "is_valid").agg(F.count("*").alias("requests"), F.sum("request_s").alias("total_s"))
