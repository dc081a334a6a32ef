"""Exact order statistics that never sort a whole group in one task.

A group may hold a third of all rows, so no window here runs over all rows of a large group. Each wanted rank starts with
its group's whole range of values. While more than ``MOST_RANKED`` rows lie in the range, they are counted per bin of it,
combined before the shuffle, and the range shrinks to the values of the one bin that holds the rank; its exact smallest
and largest value are the next range. Only the rows of the final ranges are counted per value and ranked. So the rows
that move are the counts of at most ``BINS`` bins for each range, and no caller has to guess a width.

The ranges, one row for each group and rank, are written between the rounds. The planner sees their size and broadcasts
them when they are small.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripspark.operators.lookups import null_safe
from tripspark.session import materialize

Rank = Callable[[Column], Column]
Ranks = Callable[[Column], Column]


@dataclass(frozen=True)
class Quantile:
    """Which order statistics a quantile reads, as 1-based ranks of ``n`` values.

    ``q`` is a number, or the name of a group column that holds one.
    """

    q: float | str
    method: str = "linear"

    def level(self) -> Column:
        return F.col(self.q) if isinstance(self.q, str) else F.lit(float(self.q))

    def position(self, n: Column) -> Column:
        return (n - 1) * self.level()

    def ranks(self) -> tuple[Rank, ...]:
        if self.method == "linear":
            return (
                lambda n: F.floor(self.position(n)) + 1,
                lambda n: F.ceil(self.position(n)) + 1,
            )
        if self.method == "nearest":
            return (lambda n: F.floor(self.position(n) + 0.5) + 1,)
        if self.method == "conformal":
            # q is the miss rate; a rank beyond the sample falls back to the largest value.
            return (lambda n: F.least(F.ceil((n + 1) * (F.lit(1.0) - self.level())), n),)
        raise ValueError(f"unknown quantile method {self.method!r}")

    def combine(self, values: Sequence[Column], n: Column) -> Column:
        if self.method != "linear":
            return values[0]
        low, high = values
        part = self.position(n) - F.floor(self.position(n))
        return low + (high - low) * part


#: Rows of one range that one task may rank, and bins that a longer range is counted in.
MOST_RANKED = 200_000
BINS = 4096


def order_statistics(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    ranks: Ranks,
    *,
    weight: str | None = None,
    most: int = MOST_RANKED,
) -> DataFrame:
    """The values at the wanted 1-based ranks of each group, one row per rank.

    ``ranks(n)`` is an array of (i, rank) for a group of ``n`` rows and may read the group columns; ranks outside
    1..n are left out. Null values are left out. ``df`` is read once for the sizes of the groups, once for each
    round of shrinking (none for small groups) and once for the rows of the final ranges.
    Columns: groups, n, i, rank, value, below (rows with a smaller value).
    """
    keys = list(groups)
    held = F.col(weight) if weight else F.lit(1)
    rows = df.select(*keys, F.col(value).alias("_v"), held.cast("bigint").alias("_w")).filter(F.col("_v").isNotNull())
    sizes = rows.groupBy(*keys).agg(
        F.sum("_w").alias("n"), F.count("*").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    wanted = F.filter(ranks(F.col("n")), lambda pick: (pick["rank"] >= 1) & (pick["rank"] <= F.col("n")))
    start = sizes.filter("n IS NOT NULL").select("*", F.lit(0).cast("bigint").alias("_base"), F.inline(wanted))
    ranges = materialize(start, "rank-ranges")
    kept = [*keys, "n", "i", "rank"]
    while True:
        large = ranges.filter((F.col("_rows") > most) & (F.col("_lo") < F.col("_hi")))
        if large.isEmpty():
            break
        small = ranges.filter(~((F.col("_rows") > most) & (F.col("_lo") < F.col("_hi"))))
        ranges = materialize(small.unionByName(_shrunk(rows, large, keys, kept)), "rank-ranges")
    places = ranges.select(*keys, "_lo", "_hi", "_base").distinct()
    counts = _inside(rows, places, keys).groupBy(*keys, "_lo", "_hi", "_base", "_v").agg(F.sum("_w").alias("_n"))
    so_far = Window.partitionBy(*keys, "_lo", "_hi", "_base").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select("*", (F.col("_base") + F.sum("_n").over(so_far)).alias("_upto"))
    found = counts.select(
        *[F.col(k).alias(f"_c_{k}") for k in [*keys, "_lo", "_hi", "_base"]],
        F.col("_v").alias("value"),
        (F.col("_upto") - F.col("_n")).alias("below"),
        "_upto",
    )
    pairs = [(k, f"_c_{k}") for k in [*keys, "_lo", "_hi", "_base"]]
    joined = ranges.join(found, null_safe(ranges, found, pairs))
    hit = joined.filter((F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("_upto")))
    return hit.select(*kept, "value", "below")


def _inside(rows: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of each range, with its columns. Ranges of a group touch no value twice, but may be the same."""
    names = {k: f"_t_{k}" for k in keys}
    slim = ranges.withColumnsRenamed(names).withColumn("_one", F.lit(1))
    on = [(k, names[k]) for k in keys] + [("_one", "_one")]
    marked = rows.withColumn("_one", F.lit(1))
    joined = marked.join(slim, null_safe(marked, slim, on)).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    return joined.drop("_one", *names.values())


def _shrunk(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Each range cut to the values of the bin that holds its rank."""
    place = [*keys, "_lo", "_hi", "_base"]
    low, high = F.col("_lo").cast("double"), F.col("_hi").cast("double")
    # Halved, so that the widest ranges do not overflow. The largest value has a bin of its own, so every round
    # takes something off.
    part = (F.col("_v").cast("double") / 2 - low / 2) / F.nullif(high / 2 - low / 2, F.lit(0.0))
    part = F.when(F.col("_v") == F.col("_hi"), BINS).when(F.col("_v") == F.col("_lo"), -1).otherwise(
        F.coalesce(F.floor(F.when(~F.isnan(part), part) * BINS), F.lit(0))
    )
    binned = _inside(rows, ranges.select(*place).distinct(), keys).withColumn("_bin", part)
    bins = binned.groupBy(*place, "_bin").agg(
        F.sum("_w").alias("_n"), F.count("*").alias("_rows"), F.min("_v").alias("_from"), F.max("_v").alias("_to")
    )
    so_far = Window.partitionBy(*place).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.select("*", (F.col("_base") + F.sum("_n").over(so_far)).alias("_upto"))
    renamed = bins.select(*[F.col(c).alias(f"_b_{c}") for c in place], "_n", F.col("_rows").alias("_left"), "_from", "_to", "_upto")
    joined = ranges.join(renamed, null_safe(ranges, renamed, [(c, f"_b_{c}") for c in place]))
    hit = joined.filter((F.col("rank") > F.col("_upto") - F.col("_n")) & (F.col("rank") <= F.col("_upto")))
    return hit.select(
        *[c for c in kept if c not in ("i", "rank")],
        F.col("_left").alias("_rows"),
        F.col("_from").alias("_lo"),
        F.col("_to").alias("_hi"),
        (F.col("_upto") - F.col("_n")).alias("_base"),
        "i",
        "rank",
    )


def group_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    quantiles: Mapping[str, Quantile],
    *,
    weight: str | None = None,
    most: int = MOST_RANKED,
) -> DataFrame:
    """Exact quantiles per group: columns ``groups``, ``n`` and one per quantile."""
    wanted: list[Rank] = []
    place: dict[str, list[int]] = {}
    for name, quantile in quantiles.items():
        own = quantile.ranks()
        place[name] = list(range(len(wanted), len(wanted) + len(own)))
        wanted.extend(own)

    def ranks(n: Column) -> Column:
        return F.array(
            *[F.struct(F.lit(i).alias("i"), rank(n).cast("bigint").alias("rank")) for i, rank in enumerate(wanted)]
        )

    found = order_statistics(df, groups, value, ranks, weight=weight, most=most)
    wide = found.groupBy(*groups).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("i") == i, F.col("value").cast("double"))).alias(f"_r{i}") for i in range(len(wanted))],
    )
    out = [
        quantile.combine([F.col(f"_r{i}") for i in place[name]], F.col("n")).alias(name)
        for name, quantile in quantiles.items()
    ]
    return wide.select(*groups, "n", *out)


def row_edges(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    tie: str,
    parts: Callable[[Column], Column],
    *,
    most: int = MOST_RANKED,
) -> DataFrame:
    """First row of each of ``parts(n)`` equal-count slices per group, as an ascending ``edges`` array.

    Slice ``i`` of ``b`` starts at position ``floor(i * n / b)`` in (value, tie) order. Rows that share the
    boundary value are split by the tie column with a second ranking over just those rows.
    """

    def starts(n: Column, below: Column) -> Column:
        slices = F.sequence(F.lit(0), (parts(n) - 1).cast("int"))
        return F.transform(
            slices,
            lambda i: F.struct(i.alias("i"), (F.floor(i * n / parts(n)) + 1 - below).cast("bigint").alias("rank")),
        )

    first = order_statistics(df, groups, value, lambda n: starts(n, F.lit(0)), most=most)
    wanted = first.groupBy(*groups, "value").agg(F.max("n").alias("_e_n"), F.max("below").alias("_e_below"))
    # One row per group and slice; written, so the planner broadcasts it by its size.
    wanted = materialize(wanted, "slice-values")
    renamed = wanted.select(
        *[F.col(g).alias(f"_e_{g}") for g in groups], F.col("value").alias("_e_value"), "_e_n", "_e_below"
    )
    source = df.select(*groups, value, tie)
    pairs = [(g, f"_e_{g}") for g in groups] + [(value, "_e_value")]
    boundary = source.join(renamed, null_safe(source, renamed, pairs)).drop(
        *[f"_e_{g}" for g in groups], value
    )
    # Counted from the first row of the boundary value; starts at other values fall outside and are left out.
    chosen = order_statistics(
        boundary,
        [*groups, "_e_value", "_e_n", "_e_below"],
        tie,
        lambda _: starts(F.col("_e_n"), F.col("_e_below")),
        most=most,
    )
    edge = F.struct(F.col("_e_value").alias("edge_value"), F.col("value").alias("edge_tie"))
    return chosen.groupBy(*groups).agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def slice_of(edges: Column, value: Column, tie: Column, max_parts: int) -> Column:
    """Zero-based slice of a row, given the ascending slice starts. Written out, so that it stays compiled."""
    passed = []
    for i in range(max_parts):
        edge = F.get(edges, F.lit(i))
        reached = (edge["edge_value"] < value) | ((edge["edge_value"] == value) & (edge["edge_tie"] <= tie))
        passed.append(F.when(reached, 1).otherwise(0))
    return reduce(lambda a, b: a + b, passed) - 1
