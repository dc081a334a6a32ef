"""Feature registry and the feature matrix.

A feature is a name, a family, a type, an expression over the assembled columns, and the live state it needs.
Batch and streaming jobs use the same expressions, so there is only one definition to get wrong.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from tripspark.functions import clock, vectors
from tripspark.functions.scores import clip_low
from tripspark.operators.lookups import join_lookup
from tripspark.operators.zone_state import attach_state
from tripspark.session import materialize
from tripspark.vocab import BOROUGH_IDS, EVAL_ONLY_COLUMNS, POST_HOC_COLUMNS, WEATHER_COLUMNS, WINDOWS_MIN

FAMILIES = ("route", "temporal", "congestion", "zone", "weather")


@dataclass(frozen=True)
class Feature:
    name: str
    family: str
    dtype: str
    expression: Column
    live_keys: tuple[str, ...] = ()

    def column(self) -> Column:
        return self.expression.cast(self.dtype).alias(self.name)

    @property
    def reads_zone_state(self) -> bool:
        return any(key.startswith("cong:") for key in self.live_keys)


class Registry:
    """Features in registration order; names are unique."""

    def __init__(self) -> None:
        self._by_name: dict[str, Feature] = {}

    def add(self, name: str, family: str, dtype: str, expression: Column, live_keys: Sequence[str] = ()) -> None:
        if name in self._by_name:
            raise ValueError(f"feature {name!r} is already registered")
        if family not in FAMILIES:
            raise ValueError(f"unknown feature family {family!r}")
        self._by_name[name] = Feature(name, family, dtype, expression, tuple(live_keys))

    def __len__(self) -> int:
        return len(self._by_name)

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    @property
    def names(self) -> list[str]:
        return list(self._by_name)

    def pick(self, names: Iterable[str] | None = None) -> list[Feature]:
        return [self._by_name[n] for n in (self._by_name if names is None else names)]

    def family(self, family: str) -> list[Feature]:
        return [f for f in self._by_name.values() if f.family == family]

    def counts(self) -> dict[str, int]:
        return {family: len(self.family(family)) for family in FAMILIES}

    def live_keys(self) -> list[str]:
        """Key templates a scorer must fetch, ``{zone}`` standing for the pickup zone."""
        return sorted({key for f in self._by_name.values() for key in f.live_keys})

    def frame(self, assembled: DataFrame, carry: Sequence[str] = (), names: Iterable[str] | None = None) -> DataFrame:
        """Carried columns and features in one projection; a carried column keeps its name, features follow."""
        picked = self.pick(names)
        taken = {f.name for f in picked}
        return assembled.select(*[c for c in carry if c not in taken], *[f.column() for f in picked])


def default_registry() -> Registry:
    registry = Registry()
    col = F.col
    local = col("request_local_s")

    # route
    for name, dtype in (
        ("route_distance_m", "float"),
        ("free_flow_duration_s", "float"),
        ("turn_count", "int"),
        ("highway_fraction", "float"),
        ("structural_detour_ratio", "float"),
    ):
        registry.add(name, "route", dtype, col(name))
    registry.add("is_intra_zone", "route", "boolean", col("pu_zone") == col("do_zone"))
    registry.add(
        "route_free_flow_speed_ms", "route", "float", col("route_distance_m") / clip_low(col("free_flow_duration_s"), 1.0)
    )
    registry.add("detour_confidence", "route", "float", F.log1p(F.coalesce("detour_trips", F.lit(0))))

    # temporal
    for name, value, period in (
        ("hour", clock.hour(local) + clock.minute(local) / 60.0, 24),
        ("dow", clock.weekday(local), 7),
        ("month", clock.month(local) - 1, 12),
    ):
        sin, cos = clock.cyclic(value, period)
        registry.add(f"{name}_sin", "temporal", "float", sin)
        registry.add(f"{name}_cos", "temporal", "float", cos)
    registry.add("minute_of_day", "temporal", "float", clock.hour(local) * 60 + clock.minute(local))
    registry.add("is_weekend", "temporal", "boolean", clock.weekday(local) >= 5)
    registry.add("is_holiday", "temporal", "boolean", clock.is_holiday(local))
    registry.add("days_since_epoch", "temporal", "float", clock.days_since_feature_epoch(local))

    # congestion
    for w in WINDOWS_MIN:
        trips, metres, seconds = col(f"completed_{w}m"), col(f"distance_m_{w}m"), col(f"duration_s_{w}m")
        keys = {kind: f"cong:{kind}:{{zone}}:{w}m" for kind in ("completed", "distance", "duration")}
        registry.add(
            f"zone_speed_ratio_{w}m",
            "congestion",
            "float",
            metres / clip_low(seconds, 1.0) / clip_low(col("pu_reference_speed_ms"), 0.1),
            (keys["distance"], keys["duration"]),
        )
        registry.add(f"zone_completed_trips_{w}m", "congestion", "float", trips, (keys["completed"],))
        registry.add(
            f"zone_trip_density_{w}m",
            "congestion",
            "float",
            trips / clip_low(col("pu_area_km2"), 0.01),
            (keys["completed"],),
        )
        registry.add(
            f"zone_mean_trip_duration_{w}m",
            "congestion",
            "float",
            seconds / clip_low(trips, 1.0),
            (keys["duration"], keys["completed"]),
        )

    # zone
    for side in ("pu", "do"):
        registry.add(f"{side}_area_km2", "zone", "float", col(f"{side}_area_km2"))
        registry.add(f"{side}_is_airport", "zone", "boolean", col(f"{side}_is_airport"))
        registry.add(f"{side}_hist_mean_duration_s", "zone", "float", col(f"{side}_hist_mean_duration_s"))
    registry.add("same_borough", "zone", "boolean", col("pu_borough_id") == col("do_borough_id"))
    registry.add("zone_embedding_similarity", "zone", "float", vectors.cosine(col("pu_embedding"), col("do_embedding")))

    # weather
    for name in WEATHER_COLUMNS:
        registry.add(name, "weather", "float", col(name), (f"wx:{name}",))
    evening = clock.hour(local).between(16, 19).cast("float")
    registry.add(
        "precip_x_peak", "weather", "float", F.coalesce("precip_mm_h", F.lit(0.0)) * evening, ("wx:precip_mm_h",)
    )
    return registry


# The trip layout's own names for columns that are only known after the trip.
LATE_COLUMNS = POST_HOC_COLUMNS | EVAL_ONLY_COLUMNS | {"on_scene_s", "pickup_s", "dropoff_s"}


def check_no_leakage(assembled: DataFrame, registry: Registry) -> None:
    """Refuse features that read a column known only after the trip.

    The features are analysed over the frame without those columns, so any read of one fails by name. The zone
    state is built from finished trips by design; it enters as its own columns, strictly before the request.
    """
    named = LATE_COLUMNS.intersection(registry.names)
    if named:
        raise ValueError(f"features known only after the trip: {sorted(named)}")
    try:
        _ = registry.frame(assembled.drop(*LATE_COLUMNS)).schema
    except AnalysisException as error:
        raise ValueError(f"a feature reads a column known only after the trip: {error}") from error


@dataclass(frozen=True)
class StaticTables:
    """Frozen lookup tables; one row per zone or zone pair each."""

    zones: DataFrame
    matrix: DataFrame
    detour: DataFrame
    embeddings: DataFrame
    history: DataFrame

    @cached_property
    def pair_lookup(self) -> DataFrame:
        """Written, like the tables it is made of: of a join the planner only has a guess, and would shuffle trips for it."""
        pairs = ["pu_zone", "do_zone"]
        routed = self.matrix.select(
            *pairs, "route_distance_m", "free_flow_duration_s", "turn_count", "highway_fraction"
        )
        return materialize(routed.join(self.detour, pairs, "left"), "pair-lookup")

    @cached_property
    def zone_lookup(self) -> DataFrame:
        """Written, as pairs are."""
        ids = F.create_map(*[F.lit(x) for pair in BOROUGH_IDS.items() for x in pair])
        known = F.when(F.col("borough").isNotNull(), F.try_element_at(ids, F.col("borough")))
        zones = self.zones.select(
            "zone_id", "area_km2", "is_airport", F.coalesce(known, F.lit(0)).alias("borough_id")
        )
        history = self.history.select("zone_id", "hist_mean_duration_s", "reference_speed_ms")
        joined = zones.join(history, "zone_id", "left").join(
            self.embeddings.select("zone_id", "embedding"), "zone_id", "left"
        )
        return materialize(joined, "zone-lookup")


def add_lookups(requests: DataFrame, static: StaticTables) -> DataFrame:
    """Pair columns, then every zone column once for the pickup side and once for the drop-off side."""
    pairs = ["pu_zone", "do_zone"]
    frame = join_lookup(requests, static.pair_lookup, pairs)
    by_zone = static.zone_lookup
    for side in ("pu", "do"):
        renamed = by_zone.select(
            F.col("zone_id").alias(f"{side}_zone"),
            *[F.col(c).alias(f"{side}_{c}") for c in by_zone.columns if c != "zone_id"],
        )
        frame = join_lookup(frame, renamed, [f"{side}_zone"])
    return frame


def assemble(requests: DataFrame, static: StaticTables, state: DataFrame | None = None) -> DataFrame:
    """All columns the features read. Without ``state`` the requests must carry the congestion columns, if any is read."""
    frame = attach_state(requests, state) if state is not None else requests
    return add_lookups(frame, static)


def feature_frame(
    requests: DataFrame,
    static: StaticTables,
    state: DataFrame | None = None,
    carry: Sequence[str] = (),
    names: Sequence[str] | None = None,
    registry: Registry | None = None,
) -> DataFrame:
    return (registry or default_registry()).frame(assemble(requests, static, state), carry, names)
