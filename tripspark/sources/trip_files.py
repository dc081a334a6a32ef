"""Trip files: read, check, write, and plan months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tripspark.functions import clock
from tripspark.vocab import LOCAL_TZ, TRIP_COLUMNS, TRIP_TIMESTAMPS

TRIP_SCHEMA = T.StructType(
    [
        T.StructField(
            name,
            T.TimestampNTZType()
            if name in TRIP_TIMESTAMPS
            else T.StringType()
            if name == "hvfhs_license_num"
            else T.DoubleType()
            if name == "trip_miles"
            else T.LongType(),
        )
        for name in TRIP_COLUMNS
    ]
)


def localise(raw: DataFrame, tz: str = LOCAL_TZ) -> DataFrame:
    """Raw columns to the trip layout: instants, the request's wall clock, zones as integers.

    A time that does not exist (spring gap) becomes null; a time that exists twice is the earlier instant.
    """

    # Columns of their own, so that each time is converted once and back once.
    converted = raw.withColumns({f"_{c}": clock.as_utc(F.col(c), tz) for c in TRIP_TIMESTAMPS})
    checked = converted.withColumns(
        {f"_{c}": F.when(clock.exists(F.col(c), F.col(f"_{c}"), tz), F.col(f"_{c}")) for c in TRIP_TIMESTAMPS}
    )

    def instant(name: str) -> F.Column:
        return clock.ntz_seconds(F.col(f"_{name}_datetime")).alias(f"{name}_s")

    wall = F.when(F.col("_request_datetime").isNotNull(), clock.ntz_seconds(F.col("request_datetime")))
    return checked.select(
        F.col("hvfhs_license_num").alias("operator"),
        instant("request"),
        wall.alias("request_local_s"),
        *[instant(n) for n in ("on_scene", "pickup", "dropoff")],
        F.col("PULocationID").cast("bigint").alias("pu_zone"),
        F.col("DOLocationID").cast("bigint").alias("do_zone"),
        "trip_miles",
        "trip_time",
    )


def read_trips(spark: SparkSession, *paths: str) -> DataFrame:
    """Scan trip files (globs allowed); only the nine used columns are read."""
    return localise(spark.read.schema(TRIP_SCHEMA).parquet(*paths))


def file_check(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Decode one column of every file: rows and largest value per file. A damaged file fails the job by name."""
    frame = spark.read.option("ignoreCorruptFiles", "false").parquet(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return frame.groupBy(name.alias("file")).agg(F.count("*").alias("rows"), F.max(column).alias("newest"))


def write_months(trips: DataFrame, path: str, *, by: Sequence[str] = ("month",)) -> DataFrame:
    """Write one folder per month, compressed, and return the row counts read back from what was written."""
    dated = trips.withColumn("month", clock.month_label(F.col("request_local_s")))
    # Rebalancing gathers a month's rows into files of a good size and splits a month that is too big for a task;
    # rows are sorted by pickup zone inside a file, for better statistics.
    sorted_rows = dated.hint("rebalance", *by).sortWithinPartitions(*by, "pu_zone")
    sorted_rows.write.option("compression", "zstd").partitionBy(*by).mode("error").parquet(path)
    return trips.sparkSession.read.parquet(path).groupBy("month").agg(F.count("*").alias("rows"))


def missing_months(trips: DataFrame, first: str, last: str) -> DataFrame:
    """Months of the plan, inclusive, that have no trip."""
    spark = trips.sparkSession
    plan = spark.range(1).select(
        F.explode(
            F.sequence(F.lit(f"{first}-01").cast("date"), F.lit(f"{last}-01").cast("date"), F.expr("INTERVAL 1 MONTH"))
        ).alias("day")
    )
    present = trips.select(clock.month_label(F.col("request_local_s")).alias("month")).distinct()
    return plan.select(F.date_format("day", "yyyy-MM").alias("month")).join(present, "month", "left_anti")


def read_zone_lookup(spark: SparkSession, path: str) -> DataFrame:
    schema = "LocationID BIGINT, Borough STRING, Zone STRING, service_zone STRING"
    frame = spark.read.option("header", "true").schema(schema).csv(path)
    return frame.withColumnsRenamed({"LocationID": "zone_id", "Borough": "borough", "Zone": "zone_name"})


def read_weather_reports(spark: SparkSession, path: str, station: str | None = None) -> DataFrame:
    """Report files with a header, everything as text; the station comes from the file or from the caller."""
    frame = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    name = F.lit(station) if station else F.col("station")
    return frame.select(name.alias("station"), "DATE", "TMP", "WND", "VIS", "AA1", "AJ1")
