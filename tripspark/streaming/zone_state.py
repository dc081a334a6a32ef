"""Zone state kept up to date by Spark's own streaming aggregates.

Input streams have one row per finished trip or per pre-counted bucket: zone, bucket_s, completed, distance_m,
duration_s. Sums are built from the same expressions as the batch state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tripspark.operators import zone_state as batch
from tripspark.session import fresh_path
from tripspark.vocab import STATE_MEASURES, WINDOWS_MIN


def event_buckets(rows: DataFrame, lateness_s: int) -> DataFrame:
    """Five-minute totals per zone in time order of completion: a bucket is sent once no row of it can still come."""
    timed = rows.withColumn("bucket_ts", F.timestamp_seconds("bucket_s")).withWatermark(
        "bucket_ts", f"{lateness_s} seconds"
    )
    sums = [F.sum(m).alias(m) for m in STATE_MEASURES]
    totals = timed.groupBy("zone", "bucket_ts").agg(*sums)
    return totals.withColumn("bucket_s", F.unix_timestamp("bucket_ts"))


def sliding_state(rows: DataFrame, lateness_s: int, windows: Sequence[int] = WINDOWS_MIN) -> DataFrame:
    """Rolling sums at every bucket end, sent once the watermark has passed that end.

    The watermark runs on bucket ends, which lie up to the longest window ahead of the rows; the allowed lateness
    is moved by as much, so a row is late exactly when it is ``lateness_s`` behind the newest row.
    """
    ahead = max(windows) * 60
    spread = batch.spread_to_ends(rows, windows).withColumn("clock_ts", F.timestamp_seconds("clock_s"))
    timed = spread.withWatermark("clock_ts", f"{lateness_s + ahead} seconds")
    sums = timed.groupBy("zone", "clock_ts", "clock_s").agg(*batch.window_sums(windows))
    return sums.drop("clock_ts")


# ---- running ---------------------------------------------------------------------------------------------


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> tuple[DataFrame, list]:
    """Run a stream over everything its source has now; returns the result table and each batch's progress."""
    path, progress = _run(stream, name, mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(path), progress


def run_to_stream(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream into a table and read that table as the input stream of the next job."""
    path, _ = _run(stream, name, "append")
    return stream.sparkSession.readStream.schema(stream.schema).parquet(path)


def _run(stream: DataFrame, name: str, mode: str) -> tuple[str, list]:
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-progress")
    running = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    running.awaitTermination()
    return out, running.recentProgress


def dropped_by_watermark(progress: list) -> int:
    """Rows that came too late to count, over all batches."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
