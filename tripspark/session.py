"""Session settings and the one place that decides where intermediate tables live."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tripspark.vocab import LOCAL_TZ


def build_session(app: str = "tripspark", **conf: str) -> SparkSession:
    """A session with adaptive execution on; callers add master and memory."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", LOCAL_TZ)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split a hot key's partition even if that costs one more exchange later in the plan.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def session_conf(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings that hold for the jobs of a block of code; afterwards they are what they were."""
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tripspark-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, name: str, partition_by: Sequence[str]) -> str:
    path = fresh_path(df.sparkSession, name)
    # Rebalancing keeps the files per folder few and lets adaptive execution split a folder that is too big.
    balanced = df.hint("rebalance", *partition_by) if partition_by else df
    # Written once and read a few times: worth the better codec, whatever the session's default.
    balanced.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return path


def written(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """A table written once and read back, and its path, for callers that remove it when they are done."""
    path = _write(df, name, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table once and read it back.

    Lineage is cut on reliable storage, so a lost executor costs a re-read and not a re-run, and the
    planner sees the true size: it broadcasts the table only when that is under the session's limit.
    """
    return written(df, name, partition_by)[0]


def removed(spark: SparkSession, paths: Sequence[str]) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def is_written(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


_WRITTEN: dict[tuple[str, str, str], tuple[str, StructType, str]] = {}


def folder_stamp(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of a folder's files and of the files of its tables; empty where there is no folder."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return ""
    seen = []
    for entry in files.listStatus(top):
        inside = files.listStatus(entry.getPath()) if entry.isDirectory() else [entry]
        seen += [f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in inside]
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()


def already_written(spark: SparkSession, scope: str, name: str) -> DataFrame | None:
    """A table of ``written_once``, if this application has it and the folder's files didn't change since."""
    known = _WRITTEN.get((spark.sparkContext.applicationId, scope, name))
    if known is None or known[2] != folder_stamp(spark, scope) or not is_written(spark, known[0]):
        return None
    return spark.read.schema(known[1]).parquet(known[0])


def written_once(
    spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = ()
) -> DataFrame:
    """A table derived from the folder ``scope`` that many jobs read: written by the first of them in this application,
    and again if the shared folder was emptied or the folder's files changed since."""
    found = already_written(spark, scope, name)
    if found is not None:
        return found
    stamp, table = folder_stamp(spark, scope), build()
    path = _write(table, name, partition_by)
    _WRITTEN[spark.sparkContext.applicationId, scope, name] = (path, table.schema, stamp)
    return spark.read.schema(table.schema).parquet(path)
