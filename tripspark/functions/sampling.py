"""Key hashes: the same key is in or out of a sample whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tripspark.config import tier_threshold
from tripspark.operators.orderstats import order_statistics
from tripspark.vocab import HASH_MODULUS


def key_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """Hash of the key columns that exist, from 0 to 9999. MD5 keeps it equal in every engine."""
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError(f"none of the sampling keys {tuple(columns)} is present")
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in present])
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(HASH_MODULUS)).cast("int")


def in_tier(hash_column: Column, tier: str) -> Column:
    return hash_column < tier_threshold(tier)


def order_hash(columns: Sequence[str], seed: int = 0) -> Column:
    """A number below 2^60 from the seed and the key columns; null reads as empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def sample_of_size(df: DataFrame, keys: Sequence[str], size: int, seed: int = 0) -> DataFrame:
    """Exactly ``size`` rows of ``df``, or all if there are fewer: those with the smallest hashes of their keys.

    The same rows whatever the partitioning. The hash at rank ``size`` is found without sorting the rows; rows that
    share it are taken in key order, and of rows that are equal in all keys any are the sample's.
    """
    if size < 0:
        raise ValueError("a sample cannot have fewer than no rows")
    if size == 0:
        return df.limit(0)
    hashed = df.select(F.struct("*").alias("row"), F.struct(*keys).alias("key"), order_hash(keys, seed).alias("hash"))
    at_rank = F.array(F.struct(F.lit(0).alias("i"), F.lit(size).cast("bigint").alias("rank")))
    found = order_statistics(hashed, [], "hash", lambda n: at_rank).first()
    if found is None:
        return df
    below = hashed.filter(F.col("hash") < found["value"])
    # Rows with the very hash at the rank: one, but for equal keys and collisions of 60 bits. No task sorts them all.
    tied = hashed.filter(F.col("hash") == found["value"]).orderBy("key").limit(size - found["below"])
    return below.unionByName(tied).select("row.*")
