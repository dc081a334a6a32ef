"""Run a query on Spark and its oracle on DuckDB and compare rows, column names and values."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return ("f", "nan") if math.isnan(value) else ("f", repr(value + 0.0))
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    return [columns[i] for i in order], body


def differences(entry, spark, con, sf_dir) -> str | None:
    df = entry.run(spark, sf_dir)
    got = table(df.columns, df.collect())
    if entry.sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(entry.sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if not got[1]:
        return "both sides are empty" if not want[1] else f"0 rows != {len(want[1])}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}\n  spark  {got[1][:2]}\n  oracle {want[1][:2]}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        shown = "\n".join(f"  spark  {g}\n  oracle {w}" for g, w in bad[:3])
        return f"{len(bad)} of {len(got[1])} rows differ {got[0]}\n{shown}"
    return None
