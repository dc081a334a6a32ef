"""The model matrix: sampled requests of the first four splits with all features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tripspark.functions.sampling import in_tier, key_hash
from tripspark.operators.features import StaticTables, default_registry, feature_frame
from tripspark.operators.zone_state import zone_state
from tripspark.vocab import COMPONENTS, SEGMENT_COLUMNS, TARGET

MODEL_SPLITS = ("train", "cal", "val", "test")
CARRY = (
    "trip_id",
    TARGET,
    "request_s",
    "request_local_s",
    "pu_zone",
    "do_zone",
    "operator",
    "split",
    *SEGMENT_COLUMNS,
    *COMPONENTS,
)


def model_matrix(
    trips: DataFrame,
    static: StaticTables,
    tier: str,
    key: Sequence[str],
    carry: Sequence[str] = CARRY,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Sampling comes first, so only the sampled requests are shuffled; the zone state still sees all trips.

    With ``names`` only these features are built, and trips meet the zone state only if one of them reads it.
    """
    sampled = trips.filter(F.col("split").isin(*MODEL_SPLITS) & in_tier(key_hash(trips, key), tier))
    registry = default_registry()
    state = zone_state(trips) if any(f.reads_zone_state for f in registry.pick(names)) else None
    return feature_frame(sampled, static, state, carry, names, registry)


def write_model_matrix(matrix: DataFrame, path: str) -> None:
    """A folder per split, written by each task from the rows it has: a split of nearly all rows is many files without
    another shuffle of the whole matrix."""
    matrix.write.partitionBy("split").option("compression", "zstd").parquet(path)


def load_split(spark, path: str, split: str) -> DataFrame:
    """Rows of one split; the other splits' folders are not read."""
    return spark.read.parquet(path).filter(F.col("split") == split)


def population_digest(frame: DataFrame, keys: Sequence[str] = ("request_s", "pu_zone", "do_zone")) -> DataFrame:
    """Sixteen hex digits that identify a set of rows, whatever their order or partitioning.

    Counts, sums and ranges alone can collide, so a hash of every row goes in as well.
    """
    stats = [F.count("*")]
    for key in keys:
        stats += [F.sum(key), F.min(key), F.max(key)]
    row_text = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    stats.append(F.sum(F.conv(F.substring(row_text, 1, 8), 16, 10).cast("bigint")))
    text = F.concat_ws(";", *[F.coalesce(s.cast("string"), F.lit("")) for s in stats])
    return frame.agg(F.count("*").alias("rows"), F.substring(F.sha2(text, 256), 1, 16).alias("digest"))
