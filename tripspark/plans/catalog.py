"""Names every query and, where SQL can say it, the oracle it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tripspark.plans.oracle import with_views

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    covers: tuple[str, ...]
    run: Query
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, the survey rows it covers, and its oracle."""

    def add(run: Query) -> Query:
        if name in CATALOG:
            raise ValueError(f"duplicate query name: {name}")
        CATALOG[name] = Entry(name, tuple(covers.split()), run, with_views(sql) if sql else None)
        return run

    return add


def load() -> dict[str, Entry]:
    """Import every module that registers queries."""
    from importlib import import_module

    for module in ("trips", "reference", "features", "evaluation", "calibration", "models", "streams", "reports"):
        import_module(f"tripspark.plans.{module}")
    return CATALOG
