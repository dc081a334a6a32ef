"""Ingest of many raw trip files as one job: what came of each file, and the trips of those that can be read.

A damaged file is named and set aside as a whole; none of its rows enter, so a half-read file cannot pass for a month with
few trips. Files of older layouts are read by the same schema: narrower numbers are widened, a column that a file lacks
is null in its rows and named in its outcome.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.functions import clock
from tripspark.operators import cleaning
from tripspark.session import materialize
from tripspark.sources.trip_files import TRIP_SCHEMA, localise
from tripspark.vocab import LOCAL_TZ, TRIP_COLUMNS, TRIP_TIMESTAMPS

_OUTCOME = "file string, status string, rows long, gap_nulls long, lacking array<string>"


def list_files(spark: SparkSession, *globs: str) -> list[str]:
    """Data files that the globs name, sorted. Marker and hidden files are no data files."""
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), set()
    for glob in globs:
        path = jvm.org.apache.hadoop.fs.Path(glob)
        for status in path.getFileSystem(conf).globStatus(path) or ():
            if status.isFile() and not status.getPath().getName().startswith(("_", ".")):
                found.add(status.getPath().toString())
    return sorted(found)


def _raw(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    return spark.read.option("ignoreCorruptFiles", "false").schema(TRIP_SCHEMA).parquet(*files)


def _apart(files: Sequence[str], job: Callable[[list[str]], object]) -> tuple[list[tuple[list[str], object]], list[str]]:
    """What a job gives for the parts of the list that it gets through, and the files that it fails on alone."""
    waiting, done, failed = [list(files)] if files else [], [], []
    while waiting:
        part = waiting.pop()
        try:
            done.append((part, job(part)))
        except (PySparkException, Py4JJavaError):
            if len(part) == 1:
                failed += part
            else:
                waiting += [part[: len(part) // 2], part[len(part) // 2 :]]
    return done, failed


def _measured(spark: SparkSession, files: Sequence[str], tz: str) -> DataFrame:
    """Rows of each file with every used column decoded, times that don't exist, and columns it has no value of."""
    raw = _raw(spark, files)
    # No time, no gap: the comparison is null then.
    gaps = [
        F.coalesce(~clock.exists(F.col(c), clock.as_utc(F.col(c), tz), tz), F.lit(False)).cast("int")
        for c in TRIP_TIMESTAMPS
    ]
    known = [F.when(F.count(c) == 0, F.lit(c)) for c in TRIP_COLUMNS]
    return raw.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.lit("read").alias("status"),
        F.count("*").alias("rows"),
        F.sum(sum(gaps, F.lit(0))).alias("gap_nulls"),
        F.array_compact(F.array(*known)).alias("lacking"),
    )


def file_outcomes(spark: SparkSession, files: Sequence[str], tz: str = LOCAL_TZ) -> DataFrame:
    """One row per file: read, empty or damaged, its rows, times lost in the clock change, columns it lacks.

    A first job opens all files without decoding a column, a second decodes those that open. Only if one fails, its list
    is halved until the files that fail stand alone, so one damaged file among n costs about 2 log n jobs, which decode
    nothing if the file does not even open.
    """
    opened, closed = _apart(files, lambda part: _raw(spark, part).count())
    readable = [f for part, _ in opened for f in part]
    measured, torn = _apart(readable, lambda part: materialize(_measured(spark, part, tz), "file-outcomes"))
    damaged = [(f, "damaged", 0, 0, []) for f in closed + torn]
    named = spark.createDataFrame([(f,) for f in files], "file string")
    bad = spark.createDataFrame(damaged, _OUTCOME)
    seen = reduce(DataFrame.unionByName, [found for _, found in measured], bad)
    # A file without rows is in no group.
    keyed = seen.withColumn("_key", _plain(F.col("file"))).drop("file")
    listed = named.withColumn("_key", _plain(F.col("file"))).join(keyed, "_key", "left").drop("_key")
    return listed.select(
        "file",
        F.coalesce("status", F.lit("empty")).alias("status"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("gap_nulls", F.lit(0)).alias("gap_nulls"),
        F.coalesce("lacking", F.array().cast("array<string>")).alias("lacking"),
    )


def _plain(path: Column) -> Column:
    """A file's path without scheme slashes, which listings and readers write differently."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


@dataclass(frozen=True)
class Ingested:
    """Trips of all files that could be read, and what came of every file."""

    trips: DataFrame
    outcomes: DataFrame

    def report(self) -> DataFrame:
        """Rows in, kept and dropped per month with a total line."""
        return cleaning.monthly_report(self.trips)

    def clean(self) -> DataFrame:
        return cleaning.clean(self.trips)


def ingest(spark: SparkSession, *globs: str, tz: str = LOCAL_TZ) -> Ingested:
    """Read the raw files that the globs name. No file at all, or none that can be read, is an error."""
    files = list_files(spark, *globs)
    if not files:
        raise FileNotFoundError(f"no trip file matches {globs}")
    outcomes = materialize(file_outcomes(spark, files, tz), "ingest-outcomes")
    # One row per file.
    sound = [r["file"] for r in outcomes.filter("status = 'read'").select("file").collect()]
    if not sound:
        raise ValueError(f"none of {len(files)} trip files can be read")
    return Ingested(localise(spark.read.schema(TRIP_SCHEMA).parquet(*sound), tz), outcomes)
