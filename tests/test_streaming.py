import datetime as dt

import pytest
from pyspark.sql import functions as F

from tripspark.operators import zone_state as batch
from tripspark.streaming import live_table, replay, scoring, zone_state as live

SCHEMA = "zone long, bucket_s long, completed long, distance_m double, duration_s long"


def write(spark, path, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{name}")


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


# A stream's watermark starts at the epoch, so nothing may happen before it.
START = 1_000_000 * 300


def row(zone, minute, n=1):
    return (zone, START + minute * 60, n, n * 100.0, n * 60)


def minute(seconds):
    return (seconds - START) // 60


def test_stream_equals_batch_once_the_end_has_passed(spark, tmp_path):
    rows = [row(z, m, 1 + m % 3) for z in (1, 2) for m in range(0, 600, 5) if (m // 5 + z) % 3]
    write(spark, tmp_path, "a", rows)
    table, _ = live.run_to_table(live.sliding_state(stream(spark, tmp_path), 300), "equal")
    want = batch.decayed_state(spark.createDataFrame(rows, SCHEMA)).filter(F.col("clock_s") <= max(r[1] for r in rows) - 300)
    columns = sorted(want.columns)
    key = lambda frame: sorted(tuple(r) for r in frame.select(*columns).collect())
    assert key(table) == key(want)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    write(spark, tmp_path, "f1", [row(1, 0), row(1, 60)])
    write(spark, tmp_path, "f2", [row(1, 120)])
    write(spark, tmp_path, "f3", [row(1, 5), row(1, 125)])
    write(spark, tmp_path, "f4", [row(1, 200)])
    ordered = sorted(tmp_path.glob("f*"))
    assert len(ordered) == 4
    table, progress = live.run_to_table(live.event_buckets(stream(spark, tmp_path), 600), "late")
    got = {minute(r["bucket_s"]): r["completed"] for r in table.collect()}
    assert live.dropped_by_watermark(progress) == 1
    assert got == {0: 1, 60: 1, 120: 1, 125: 1}


def in_order(spark, path, parts):
    """Each part's rows as one file; the stream reads them one per micro-batch."""
    for n, rows in enumerate(parts):
        write(spark, path, f"p{n}", rows)
    return stream(spark, path)


def test_quiet_zones_tick_decay_and_are_cleared(spark, tmp_path):
    """Whatever the micro-batches, the ticks are those of the batch state, and a zone that comes back starts anew."""
    rows = [row(z, m, 1 + m % 3) for z in (1, 2) for m in (0, 5, 20, 90, 95, 300, 305)]
    rows += [row(3, m) for m in (0, 400)] + [row(4, 450)]
    parts = [[r for r in rows if lo <= minute(r[1]) < lo + 100] for lo in range(0, 500, 100)]
    table, _ = live.run_to_table(replay.ticking_state(in_order(spark, tmp_path, [p for p in parts if p])), "ticks")
    once, _ = live.run_to_table(replay.ticking_state(in_order(spark, tmp_path / "one", [rows])), "ticks-once")
    want = batch.decayed_state(spark.createDataFrame(rows, SCHEMA)).filter(F.col("clock_s") <= START + 450 * 60)
    columns = sorted(want.columns)
    key = lambda frame: sorted(tuple(map(float, r)) for r in frame.select(*columns).collect())
    assert key(table) == key(want) == key(once)
    zone3 = [r for r in table.filter("zone = 3").collect() if minute(r["clock_s"]) == 60]
    assert zone3[0]["completed_60m"] == 0.0


ASKED = "zone long, key_s long"


def plain_answer(rows, zone, key_s):
    """Sums of the zone's buckets up to the tick before the request's bucket; null without an earlier bucket."""
    mine = [r for r in rows if r[0] == zone and r[1] < key_s]
    if not mine:
        return (None,) * 10
    tick = key_s - 300
    sums = [sum(r[i] for r in mine if tick - 60 * w < r[1] <= tick) for w in (15, 30, 60) for i in (2, 3, 4)]
    return (tick, *map(float, sums))


@pytest.mark.parametrize("parts", [1, 6])
def test_requests_are_answered_from_buckets_before_their_own(spark, tmp_path, parts):
    rows = [row(z, m, 1 + m % 4) for z in (1, 2) for m in range(0, 600, 5) if (m // 5 + z) % 3 and not 200 < m < 320]
    asked = [(z, START + m * 60) for z in (1, 2, 9) for m in range(0, 600, 15)]
    step = 600 // parts
    for n in range(parts):
        lo, hi = START + n * step * 60, START + (n + 1) * step * 60
        write(spark, tmp_path / "rows", f"p{n}", [r for r in rows if lo <= r[1] < hi])
        spark.createDataFrame([a for a in asked if lo <= a[1] < hi], ASKED).coalesce(1).write.parquet(f"{tmp_path}/asked/p{n}")
    clocks = spark.readStream.schema(ASKED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/asked/*")
    answers, _ = live.run_to_table(replay.answered_requests(stream(spark, tmp_path / "rows"), clocks), "answers")
    got = {(r["zone"], r["key_s"]): tuple(r[c] for c in ("state_clock_s", *replay.COLUMNS)) for r in answers.collect()}
    newest = max(r[1] for r in rows)
    assert got == {(z, k): plain_answer(rows, z, k) for z, k in asked if k - 300 <= newest}
    assert any(v[0] is None for v in got.values()) and any(v[-1] == 0.0 for v in got.values())


def live_rows(table, spark):
    return {r["zone"]: (minute(r["clock_s"]), r["completed_15m"], r["completed_60m"]) for r in table.state(spark).collect()}


def test_live_table_upserts_at_one_clock_and_keeps_late_rows(spark, tmp_path):
    table = live_table.LiveTable(str(tmp_path / "live"), 600, keep=2)
    parts = [
        [row(1, 0), row(2, 5)],
        [row(1, 10, 2), row(1, 0, 3)],
        [row(2, 70), row(1, 59), (None, START, 1, 1.0, 1), (1, None, 1, 1.0, 1)],
        [row(3, 2), row(1, 61, 4)],
    ]
    frames = [spark.createDataFrame(p, SCHEMA).coalesce(1) for p in parts]
    live_table.run_arrivals(table, frames)
    # Minute 59 came with minute 70 and counts, minute 61 is behind the clock but not by too much, minute 10 has left.
    assert live_rows(table, spark) == {1: (70, 5.0, 5.0), 2: (70, 1.0, 1.0)}
    counts = table.counts(spark)
    assert (counts["in_time"], counts["late"], counts["incomplete"], counts["version"]) == (7, 1, 2, 3)
    aside = {(r["reason"], r["zone"]) for r in table.aside(spark).collect()}
    assert aside == {("late", 3), ("incomplete", None), ("incomplete", 1)}
    assert sum(f.count() for f in frames) == counts["in_time"] + counts["late"] + counts["incomplete"]
    left = sorted(p.name for p in (tmp_path / "live").glob("version=*/state"))
    assert len(left) == 2


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    table = live_table.LiveTable(str(tmp_path / "live"))
    frame = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    table.upsert(frame(row(1, 0), row(2, 0)), 0)
    table.upsert(frame(row(1, 10, 5)), 1)
    once = live_rows(table, spark)
    table.upsert(frame(row(1, 10, 5)), 1)
    assert live_rows(table, spark) == once == {1: (10, 6.0, 6.0), 2: (10, 1.0, 1.0)}
    # A batch that failed before the pointer moved is invisible, and its leftovers are overwritten.
    spark.createDataFrame([(9, START, 1.0, 1.0, 1.0)], live_table.BUCKETS).write.parquet(table._part(2, "buckets"))
    assert live_rows(table, spark) == once
    table.upsert(frame(row(2, 15)), 2)
    assert live_rows(table, spark) == {1: (15, 5.0, 6.0), 2: (15, 1.0, 2.0)}
    table.upsert(frame(), 3)
    assert live_rows(table, spark) == {1: (15, 5.0, 6.0), 2: (15, 1.0, 2.0)}
    with pytest.raises(ValueError):
        live_table.LiveTable("x", 3600)
    empty = live_table.LiveTable(str(tmp_path / "none"))
    assert empty.state(spark) is None and empty.counts(spark) is None


def test_a_scan_that_fails_costs_one_batch_its_state(spark, tmp_path):
    table = live_table.LiveTable(str(tmp_path / "live"))
    reader = live_table.StateReader(table)
    state, clock_s = reader.snapshot(spark)
    assert state.count() == 0 and clock_s is None and reader.failure_rate == 0.0
    table.upsert(spark.createDataFrame([row(1, 0)], SCHEMA), 0)
    table.upsert(spark.createDataFrame([row(1, 5)], SCHEMA), 1)
    state, clock_s = reader.snapshot(spark)
    assert minute(clock_s) == 5 and state.count() == 1
    for file in (tmp_path / "live" / "version=000000000001" / "state").glob("*.parquet"):
        # The footer stays whole, the pages do not: listing and reading the schema still work.
        data = bytearray(file.read_bytes())
        data[4 : len(data) // 3] = bytes(len(data) // 3 - 4)
        file.write_bytes(data)
    for crc in (tmp_path / "live").rglob(".*.crc"):
        crc.unlink()
    lost, clock_s = reader.snapshot(spark)
    assert lost is None and clock_s is None and reader.failure_rate == pytest.approx(1 / 3)
    asked = spark.createDataFrame([(7, 1)], "request_id int, pu_zone long")
    assert scoring.attach_live_state(asked, lost).first()["degraded"]
    # A snapshot that was taken before stays whole.
    assert state.first()["completed_15m"] == 2.0


def test_a_missing_store_degrades_and_a_cold_zone_does_not(spark):
    asked = spark.createDataFrame([(1, 1), (2, 9)], "request_id int, pu_zone long")
    sums = {c: F.lit(4.0) for c in batch.state_columns()}
    state = spark.createDataFrame([(1, 0)], "zone long, clock_s long").withColumns(sums)
    up = {r["request_id"]: r for r in scoring.attach_live_state(asked, state).collect()}
    assert up[1]["completed_60m"] == 4.0 and up[2]["completed_60m"] is None
    assert not up[1]["degraded"] and not up[2]["degraded"]
    down = scoring.attach_live_state(asked, None)
    assert all(r["degraded"] and r["duration_s_15m"] is None for r in down.collect())
    assert scoring.degraded_share(down).first()["degraded_share"] == 1.0


def test_keys_come_from_the_registry(spark):
    keys = scoring.live_keys(spark.createDataFrame([(132,)], "zone long")).collect()
    assert len(keys) == 14 and {r["namespace"] for r in keys} == {"cong", "wx"}
    assert "cong:distance:132:30m" in {r["key"] for r in keys}
    assert scoring.live_columns() == batch.state_columns()


def test_request_validity(spark):
    rows = [(1, 265, 5), (0, 3, 5), (3, 266, 5), (None, 3, 5), (3, 3, None)]
    valid, rejected = scoring.split_requests(spark.createDataFrame(rows, "pu_zone long, do_zone long, request_s long"))
    assert (valid.count(), rejected.count()) == (2, 3)
    now = dt.datetime.now().timestamp()
    assert valid.filter("pu_zone = 3").first()["request_s"] == pytest.approx(now, abs=120)


def test_scored_requests_show_their_numbers():
    """SQL must say levels, bounds and promises, not only facts about them."""
    from tripspark.plans import catalog

    sql = catalog.load()["scored_requests"].sql
    assert all(f" AS {c}" in sql for c in ("p5", "p50", "p75", "p90", "p95", "lo", "hi", "promised"))
