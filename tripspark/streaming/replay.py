"""Clock-driven state and the as-of join inside a stream, on transformWithState.

Both processors are keyed by zone, take finished five-minute buckets and run on event-time timers, so the watermark is
one clock for all zones: a zone without trips still ticks, decays and is cleared. Each holds at most the buckets of the
longest window and what still waits for the clock, in one value per zone.

They need the RocksDB state store; :func:`use_rocksdb` sets it for a session.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tripspark.operators.zone_state import state_columns
from tripspark.vocab import BUCKET_S, STATE_MEASURES, WINDOWS_MIN

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LONGEST_S = 60 * max(WINDOWS_MIN)
_BUCKET = "struct<bucket_s:bigint,completed:double,distance_m:double,duration_s:double>"
COLUMNS = state_columns()
_SUMS = ", ".join(f"{c} double" for c in COLUMNS)
TICK_SCHEMA = f"zone bigint, clock_s bigint, {_SUMS}"
ANSWER_SCHEMA = f"zone bigint, key_s bigint, state_clock_s bigint, {_SUMS}"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


class _Buckets:
    """A zone's buckets in time order, with running totals for window sums."""

    def __init__(self, held: list) -> None:
        self.sums = {int(b[0]): [float(x) for x in b[1:]] for b in held}

    def add(self, bucket_s: int, values: list[float]) -> None:
        old = self.sums.get(bucket_s)
        self.sums[bucket_s] = values if old is None else [a + b for a, b in zip(old, values, strict=True)]

    def index(self) -> list[int]:
        return sorted(self.sums)

    def window(self, times: list[int], clock_s: int) -> list[float]:
        """Sums over (clock - w, clock] for every window and measure, in the order of ``state_columns``."""
        upto, out = bisect_right(times, clock_s), []
        for w in WINDOWS_MIN:
            inside = times[bisect_right(times, clock_s - 60 * w) : upto]
            out += [sum(self.sums[t][i] for t in inside) for i in range(len(STATE_MEASURES))]
        return out

    def evict(self, clock_s: int) -> None:
        self.sums = {t: v for t, v in self.sums.items() if t > clock_s - _LONGEST_S}

    def held(self) -> list[tuple]:
        return [(t, *self.sums[t]) for t in self.index()]


def _watermark_s(timer_values) -> int:
    return timer_values.getCurrentWatermarkInMs() // 1000


class TickingZone(StatefulProcessor):
    """Publishes a zone's sums at every tick of the watermark, from its first bucket until an hour after its last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("zone", f"buckets array<{_BUCKET}>, tick_s bigint")

    def _due(self, tick_s: int) -> None:
        # One millisecond early: a timer fires once the watermark is past it.
        self.handle.registerTimer(tick_s * 1000 - 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, tick_s = self.state.get() if self.state.exists() else ([], None)
        buckets, ticking = _Buckets(held), tick_s is not None
        for part in rows:
            values = part[list(STATE_MEASURES)].to_numpy(float).tolist()
            for bucket_s, sums in zip(part["bucket_s"].tolist(), values, strict=True):
                buckets.add(int(bucket_s), sums)
        if not ticking:
            tick_s = min(buckets.sums)
            self._due(tick_s)
        self.state.update((buckets.held(), tick_s))
        yield pd.DataFrame(columns=["zone", "clock_s", *COLUMNS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, tick_s = self.state.get()
        buckets, now_s, out = _Buckets(held), _watermark_s(timerValues), []
        times = buckets.index()
        while tick_s <= now_s and tick_s <= times[-1] + _LONGEST_S:
            if tick_s <= times[bisect_right(times, tick_s) - 1] + _LONGEST_S:
                out.append((key[0], tick_s, *buckets.window(times, tick_s)))
                tick_s += BUCKET_S
            else:
                # Cleared by now; it starts again with the next bucket, as it would have if that had come later.
                tick_s = times[bisect_right(times, tick_s)]
        buckets.evict(tick_s - BUCKET_S)
        if buckets.sums:
            self.state.update((buckets.held(), tick_s))
            self._due(tick_s)
        else:
            self.state.clear()
        yield pd.DataFrame(out, columns=["zone", "clock_s", *COLUMNS])

    def close(self) -> None:
        pass


def ticking_state(buckets: DataFrame, lateness_s: int = 0) -> DataFrame:
    """Per zone and tick the sums at that tick, sent once the watermark has reached it.

    ``buckets`` is a stream of finished totals (zone, bucket_s and the measures), so a zone has one row per bucket at most
    and its trips never meet in one task.
    """
    use_rocksdb(buckets.sparkSession)
    timed = buckets.select("zone", "bucket_s", *STATE_MEASURES, F.timestamp_seconds("bucket_s").alias("event_ts"))
    timed = timed.withWatermark("event_ts", f"{lateness_s} seconds")
    return timed.groupBy("zone").transformWithStateInPandas(TickingZone(), TICK_SCHEMA, "append", "eventTime")


class AnsweringZone(StatefulProcessor):
    """Holds the requests' clocks of a zone until the watermark has reached them, and the buckets they look back on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("zone", f"buckets array<{_BUCKET}>, asked array<bigint>, first_s bigint")

    def _due(self, key_s: int) -> None:
        # What a request sees ends with the tick before its own bucket.
        self.handle.registerTimer((key_s - BUCKET_S) * 1000 - 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, asked, first_s = self.state.get() if self.state.exists() else ([], [], None)
        buckets, waiting = _Buckets(held), set(asked)
        soonest = min(waiting, default=None)
        for part in rows:
            for is_request, at_s, *values in part[["is_request", "at_s", *STATE_MEASURES]].itertuples(index=False):
                if is_request:
                    waiting.add(int(at_s))
                else:
                    buckets.add(int(at_s), [float(v) for v in values])
                    first_s = int(at_s) if first_s is None else min(first_s, int(at_s))
        if waiting and min(waiting) != soonest:
            self._due(min(waiting))
        self.state.update((buckets.held(), sorted(waiting), first_s))
        yield pd.DataFrame(columns=["zone", "key_s", "state_clock_s", *COLUMNS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, asked, first_s = self.state.get()
        buckets, now_s, out = _Buckets(held), _watermark_s(timerValues), []
        times = buckets.index()
        ready = bisect_right(asked, now_s + BUCKET_S)
        for key_s in asked[:ready]:
            known = first_s is not None and first_s < key_s
            sums = buckets.window(times, key_s - BUCKET_S) if known else [None] * len(COLUMNS)
            out.append((key[0], key_s, key_s - BUCKET_S if known else None, *sums))
        asked = asked[ready:]
        # Later requests look back from the watermark on, those that wait from their own clock on.
        buckets.evict(min([now_s, *(k - BUCKET_S for k in asked[:1])]))
        self.state.update((buckets.held(), asked, first_s))
        if asked:
            self._due(asked[0])
        yield pd.DataFrame(out, columns=["zone", "key_s", "state_clock_s", *COLUMNS])

    def close(self) -> None:
        pass


def answered_requests(buckets: DataFrame, clocks: DataFrame, lateness_s: int = 0) -> DataFrame:
    """As-of join of two streams: per (zone, key_s) of ``clocks`` the zone's sums at the last tick before ``key_s``.

    ``buckets`` has finished totals, ``clocks`` one row per zone and five-minute bucket in which requests were made; all
    requests of a bucket share its answer. An answer is sent when the watermark of both streams has reached that tick. A
    zone without any earlier bucket answers null; one that has been quiet for longer than a window answers zero.
    """
    use_rocksdb(buckets.sparkSession)
    none = [F.lit(None).cast("double").alias(m) for m in STATE_MEASURES]
    history = buckets.select(
        "zone", F.lit(False).alias("is_request"), F.col("bucket_s").alias("at_s"), *[F.col(m).cast("double").alias(m) for m in STATE_MEASURES]
    )
    asked = clocks.select("zone", F.lit(True).alias("is_request"), F.col("key_s").alias("at_s"), *none)
    both = history.unionByName(asked).withColumn("event_ts", F.timestamp_seconds("at_s"))
    timed = both.withWatermark("event_ts", f"{lateness_s} seconds")
    return timed.groupBy("zone").transformWithStateInPandas(AnsweringZone(), ANSWER_SCHEMA, "append", "eventTime")


def request_clocks(requests: DataFrame, lateness_s: int) -> DataFrame:
    """A stream of requests (pu_zone, request_s) as one row per zone and bucket, sent once no more can come for it."""
    key = (F.floor(F.col("request_s") / BUCKET_S) * BUCKET_S).cast("long")
    timed = requests.select(F.col("pu_zone").alias("zone"), F.timestamp_seconds(key).alias("key_ts"))
    timed = timed.withWatermark("key_ts", f"{lateness_s} seconds")
    return timed.groupBy("zone", "key_ts").agg(F.count("*").alias("requests")).select(
        "zone", F.unix_timestamp("key_ts").alias("key_s"), "requests"
    )
