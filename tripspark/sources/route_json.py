"""Router answers as JSON text: distance, time, turns and motorway share of the first route."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tripspark.vocab import MOTORWAY, TURN_KINDS

ROUTE_SCHEMA = """
routes ARRAY<STRUCT<
  distance: DOUBLE, duration: DOUBLE,
  legs: ARRAY<STRUCT<steps: ARRAY<STRUCT<
    distance: DOUBLE,
    maneuver: STRUCT<type: STRING, modifier: STRING>,
    intersections: ARRAY<STRUCT<classes: ARRAY<STRING>>>
  >>>>
>>
"""


def _is_turn(step: Column) -> Column:
    turned = step["maneuver"]["type"].isin(*TURN_KINDS)
    return F.coalesce(turned, F.lit(False)) & (F.coalesce(step["maneuver"]["modifier"], F.lit("")) != "straight")


def _on_motorway(step: Column) -> Column:
    inside = F.exists(
        step["intersections"],
        lambda crossing: F.coalesce(F.array_contains(crossing["classes"], MOTORWAY), F.lit(False)),
    )
    return F.coalesce(inside, F.lit(False))


def parse_route(payload: Column) -> Column:
    """Struct of route_distance_m, free_flow_duration_s, turn_count, highway_fraction; null without a route.

    What a lambda is given is computed once. An expression that several columns or lambdas read is computed in each of
    them, and here that would be the parsing of the text.
    """
    first = F.get(F.from_json(payload, ROUTE_SCHEMA)["routes"], F.lit(0))
    return F.get(F.transform(F.array(first), _measured), F.lit(0))


def _measured(first: Column) -> Column:
    no_steps = F.array().cast("array<struct<distance:double,maneuver:struct<type:string,modifier:string>,"
                              "intersections:array<struct<classes:array<string>>>>>")
    steps = F.coalesce(
        F.flatten(F.transform(first["legs"], lambda leg: F.coalesce(leg["steps"], no_steps))), no_steps
    )
    motorway_m = F.aggregate(
        F.filter(steps, _on_motorway), F.lit(0.0), lambda m, s: m + F.coalesce(s["distance"], F.lit(0.0))
    )
    distance = first["distance"]
    fraction = F.when(distance > 0, F.least(F.try_divide(motorway_m, distance), F.lit(1.0))).otherwise(0.0)
    return F.when(
        first.isNotNull(),
        F.struct(
            distance.alias("route_distance_m"),
            first["duration"].alias("free_flow_duration_s"),
            F.size(F.filter(steps, _is_turn)).alias("turn_count"),
            fraction.alias("highway_fraction"),
        ),
    )
