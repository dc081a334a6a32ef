"""Scoring promises: costs, segments, leaderboard, selection, temporal robustness, crossings, ablations.

Frames here carry ``actual`` and either ``promised`` or an ascending-level array ``q``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripspark.config import CostConfig
from tripspark.functions import clock, scores, vectors
from tripspark.operators.lookups import null_safe
from tripspark.operators.orderstats import Quantile, group_quantiles, row_edges, slice_of
from tripspark.vocab import MIN_SEGMENT_ROWS, SEGMENT_COLUMNS

METRICS = ("business_cost", "mae", "rmse", "late_rate", "pinball_at_q_star")


def by_segment(
    frame: DataFrame, aggregates: Sequence[Column], axes: Sequence[str] = SEGMENT_COLUMNS, keys: Sequence[str] = ()
) -> DataFrame:
    """The aggregates for all rows (axis ``global``, bucket ``all``) and for each bucket of each axis, in one pass.

    Rows without a bucket count globally but form no bucket of their own.
    """
    sets = [[*keys], *[[*keys, a] for a in axes]]
    grouped = frame.groupingSets([[F.col(c) for c in s] for s in sets], *keys, *axes).agg(
        *aggregates, *[F.grouping(a).alias(f"_{a}") for a in axes]
    )
    axis, bucket = F.lit("global"), F.lit("all")
    for a in axes:
        axis = F.when(F.col(f"_{a}") == 0, a).otherwise(axis)
        bucket = F.when(F.col(f"_{a}") == 0, F.col(a)).otherwise(bucket)
    named = grouped.withColumns({"axis": axis, "bucket": bucket}).filter("bucket IS NOT NULL")
    return named.drop(*axes, *[f"_{a}" for a in axes])


def metrics(cfg: CostConfig, actual: str = "actual", promised: str = "promised") -> list[Column]:
    a, p = F.col(actual), F.col(promised)
    return [
        F.count("*").alias("rows"),
        F.avg(scores.business_cost(a, p, cfg)).alias("business_cost"),
        F.avg(F.abs(p - a)).alias("mae"),
        F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"),
        scores.share(scores.is_late(a, p)).alias("late_rate"),
        F.avg(scores.pinball(a, p, cfg.optimal_quantile)).alias("pinball_at_q_star"),
    ]


def evaluate(
    frame: DataFrame,
    cfg: CostConfig,
    axes: Sequence[str] = SEGMENT_COLUMNS,
    keys: Sequence[str] = (),
    min_rows: int = MIN_SEGMENT_ROWS,
) -> DataFrame:
    """Metrics overall and for each segment bucket with enough rows."""
    out = by_segment(frame, metrics(cfg), axes, keys)
    return out.filter((F.col("axis") == "global") | (F.col("rows") >= min_rows))


def summarise_seeds(results: DataFrame) -> DataFrame:
    """Mean and sample spread per model over its seeds; refuses results from different populations."""
    populations = results.filter("population <> ''").select("population").distinct().limit(2).count()
    if populations > 1:
        raise ValueError("models were evaluated on different populations, so their costs cannot be compared")
    spread = [
        c
        for m in METRICS
        for c in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))
    ]
    return results.groupBy("model").agg(F.count("*").alias("seeds"), F.min("rows").alias("rows"), *spread)


def leaderboard(summary: DataFrame, baseline: str) -> DataFrame:
    """Models by mean cost, each with its percent difference to the named baseline."""
    reference = summary.filter(F.col("model") == baseline).select("business_cost_mean").scalar()
    change = F.try_divide((F.col("business_cost_mean") - reference) * 100.0, reference)
    return summary.withColumn("vs_baseline_pct", change).orderBy("business_cost_mean")


def segment_table(segments: DataFrame) -> DataFrame:
    """Segment metrics averaged over seeds."""
    return segments.groupBy("model", "axis", "bucket").agg(
        F.min("rows").alias("rows"), *[F.avg(m).alias(m) for m in ("business_cost", "mae", "late_rate")]
    )


def select_champion(costs: DataFrame) -> DataFrame:
    """Candidate with the lowest mean validation cost, the runner-up's margin, and whether that margin beats the
    champion's own seed spread. ``costs`` has one row per candidate and seed: model, val_cost; without any, there is
    nothing to choose from, which is an error."""
    if costs.isEmpty():
        raise ValueError("no candidate to choose a champion from")
    means = costs.groupBy("model").agg(
        F.avg("val_cost").alias("val_cost"), F.coalesce(F.stddev_samp("val_cost"), F.lit(0.0)).alias("val_cost_std")
    )
    # One row per candidate, so an unpartitioned window is a handful of rows.
    ranked = Window.orderBy("val_cost", "model")
    margin = F.coalesce(F.lead("val_cost").over(ranked) - F.col("val_cost"), F.lit(0.0))
    best = means.select("*", F.row_number().over(ranked).alias("place"), margin.alias("margin"))
    return best.filter("place = 1").select(
        F.col("model").alias("champion"),
        "val_cost",
        "val_cost_std",
        "margin",
        (F.col("margin") > F.col("val_cost_std")).alias("margin_exceeds_seed_spread"),
    )


# ---- robustness over time --------------------------------------------------------------------------------


def temporal_windows(
    frame: DataFrame, cfg: CostConfig, labels: Sequence[str] = ("early", "middle", "late"), tie: str = "trip_id"
) -> DataFrame:
    """Paired costs and late rates in consecutive windows with equally many rows, by request time.

    Rows of the same second are split by the id column.
    """
    n_windows = len(labels)
    marked = frame.withColumn("_all", F.lit(1))
    edges = row_edges(marked, ["_all"], "request_s", tie, lambda n: F.lit(n_windows))
    # One row.
    sliced = marked.withColumn("edges", edges.select("edges").scalar())
    named = F.element_at(
        F.array(*[F.lit(x) for x in labels]), slice_of(F.col("edges"), F.col("request_s"), F.col(tie), n_windows) + 1
    )
    actual, champion, baseline = F.col("actual"), F.col("promised"), F.col("baseline")
    out = sliced.groupBy(named.alias("window")).agg(
        F.count("*").alias("rows"),
        F.avg(scores.business_cost(actual, champion, cfg)).alias("champion_cost"),
        F.avg(scores.business_cost(actual, baseline, cfg)).alias("baseline_cost"),
        scores.share(actual > champion).alias("champion_late"),
        scores.share(actual > baseline).alias("baseline_late"),
    )
    change = (F.col("champion_cost") - F.col("baseline_cost")) * 100.0
    return out.withColumn("improvement_pct", F.try_divide(change, F.col("baseline_cost")))


def daily_differences(frame: DataFrame, cfg: CostConfig) -> DataFrame:
    """Mean cost of champion minus baseline per request day; negative favours the champion."""
    actual = F.col("actual")
    diff = scores.business_cost(actual, F.col("promised"), cfg) - scores.business_cost(actual, F.col("baseline"), cfg)
    local = F.col("request_local_s")
    return frame.groupBy(clock.epoch_day(local).alias("day")).agg(
        F.avg(diff).alias("mean_diff"), F.min(clock.weekday(local)).alias("weekday")
    )


def losing_streak(days: DataFrame) -> DataFrame:
    """Longest run of consecutive observed days with a difference of zero or more.

    Days are one row each, so the unpartitioned order is a few hundred rows a year.
    """
    in_time = Window.orderBy("day")
    lost = F.col("mean_diff") >= 0
    wins_so_far = F.sum((~lost).cast("int")).over(in_time.rowsBetween(Window.unboundedPreceding, 0))
    runs = days.select(lost.alias("lost"), wins_so_far.alias("run")).filter("lost").groupBy("run").count()
    return runs.agg(F.coalesce(F.max("count"), F.lit(0)).alias("longest_losing_streak"))


def paired_blocks(frame: DataFrame, cfg: CostConfig) -> DataFrame:
    """Distribution of the daily cost differences; an error without a day to compare."""
    days = daily_differences(frame, cfg)
    if days.isEmpty():
        raise ValueError("no rows to compare in daily blocks")
    weekend = F.col("weekday") >= 5
    summary = days.agg(
        F.count("*").alias("blocks"),
        F.count_if(F.col("mean_diff") < 0).alias("champion_wins"),
        F.avg("mean_diff").alias("mean_diff"),
        F.median("mean_diff").alias("median_diff"),
        F.coalesce(F.stddev_samp("mean_diff"), F.lit(0.0)).alias("std_diff"),
        F.percentile("mean_diff", 0.1).alias("p10_diff"),
        F.percentile("mean_diff", 0.9).alias("p90_diff"),
        F.max("mean_diff").alias("worst_block_diff"),
        F.min("mean_diff").alias("best_block_diff"),
        F.avg(F.when(~weekend, F.col("mean_diff"))).alias("weekday_diff"),
        F.avg(F.when(weekend, F.col("mean_diff"))).alias("weekend_diff"),
    )
    return summary.withColumn("longest_losing_streak", losing_streak(days).scalar())


# ---- quantile rows ---------------------------------------------------------------------------------------


def level_name(level: float) -> str:
    return f"P{round(level * 100)}"


def crossing_report(frame: DataFrame, levels: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Rows with a crossing, how often each neighbouring pair crosses, worst and mean inversion."""
    if list(levels) != sorted(levels):
        raise ValueError(f"levels must ascend: {levels}")
    drops = F.filter(vectors.steps(F.col("q")), lambda d: d < 0)
    drop_sum = F.aggregate(drops, F.lit(0.0), lambda s, x: s - x)
    stepped = frame.withColumns({"_steps": vectors.steps(F.col("q")), "_drops": drops, "_drop_sum": drop_sum})
    crossed = F.size("_drops") > 0
    pairs = [
        scores.share(F.col("_steps")[i] < 0).alias(f"{level_name(a)}_over_{level_name(b)}")
        for i, (a, b) in enumerate(zip(levels, levels[1:]))
    ]
    inversions = F.sum(F.size("_drops"))
    grouped = stepped.groupBy(*keys)
    return grouped.agg(
        F.count("*").alias("rows"),
        F.count_if(crossed).alias("crossing_rows"),
        scores.share(crossed).alias("crossing_rate"),
        *pairs,
        F.coalesce(-F.min(F.array_min("_drops")), F.lit(0.0)).alias("worst_gap_s"),
        F.coalesce(F.try_divide(F.sum("_drop_sum"), inversions), F.lit(0.0)).alias("mean_gap_s"),
    )


def crossing_comparison(reports: DataFrame) -> DataFrame:
    """Crossing rate and worst inversion of each strategy over its seeds."""
    return reports.groupBy("strategy").agg(
        F.count("*").alias("seeds"),
        F.avg("crossing_rate").alias("rate_mean"),
        F.coalesce(F.stddev_samp("crossing_rate"), F.lit(0.0)).alias("rate_std"),
        F.max("worst_gap_s").alias("worst_gap_s"),
    )


def clamp_steps(steps: Column) -> Column:
    """Levels from a base and increments: negative increments count as zero."""
    return F.transform(
        steps,
        lambda _x, i: F.aggregate(
            F.slice(steps, F.lit(2), F.greatest(i, F.lit(0))),
            F.get(steps, F.lit(0)),
            lambda s, x: s + F.greatest(x, F.lit(0.0)),
        ),
    )


def clamp_stats(frame: DataFrame, levels: Sequence[float]) -> DataFrame:
    """What the clamp changed, per level above the base. ``steps`` is the base followed by raw increments."""
    long = frame.select(F.posexplode("steps").alias("i", "step")).filter("i > 0")
    adjusted = F.when(F.col("step") < 0, -F.col("step"))
    long = long.select(
        F.element_at(F.array(*[F.lit(float(x)) for x in levels]), F.col("i") + 1).alias("level"),
        adjusted.alias("adjustment"),
    )
    counts = long.groupBy("level").agg(
        F.count("*").alias("rows"),
        F.count("adjustment").alias("clamped_rows"),
        scores.share(F.col("adjustment").isNotNull()).alias("clamped_share"),
        F.coalesce(F.avg("adjustment"), F.lit(0.0)).alias("mean_adjustment_s"),
        F.coalesce(F.max("adjustment"), F.lit(0.0)).alias("max_adjustment_s"),
    )
    p95 = group_quantiles(long, ["level"], "adjustment", {"p95": Quantile(0.95)})
    joined = counts.join(p95.select("level", "p95"), "level", "left")
    return joined.withColumn("p95_adjustment_s", F.coalesce("p95", F.lit(0.0))).drop("p95")


def clamp_split(frame: DataFrame, cfg: CostConfig) -> DataFrame:
    """Champion and baseline cost on rows the clamp touched and on rows it did not."""
    raised = F.exists(F.slice("steps", 2, F.size("steps")), lambda x: x < 0)
    actual = F.col("actual")
    out = frame.groupBy(raised.alias("clamped")).agg(
        F.count("*").alias("rows"),
        F.avg(scores.business_cost(actual, F.col("promised"), cfg)).alias("champion_cost"),
        F.avg(scores.business_cost(actual, F.col("baseline"), cfg)).alias("baseline_cost"),
    )
    change = (F.col("champion_cost") - F.col("baseline_cost")) * 100.0
    return out.withColumn("improvement_pct", F.try_divide(change, F.col("baseline_cost")))


# ---- comparisons of prediction sets ----------------------------------------------------------------------


def overshoot(frame: DataFrame) -> DataFrame:
    """How far the sum of component promises lies above the direct one: columns ``direct`` and ``summed``."""
    gap = F.col("summed") - F.col("direct")
    gaps = frame.withColumns({"gap": gap, "_all": F.lit(1)})
    basic = gaps.groupBy("_all").agg(
        F.count("*").alias("rows"),
        F.avg("gap").alias("mean_overshoot_s"),
        scores.share(F.col("gap") > 0).alias("share_overshooting"),
        F.avg("direct").alias("mean_direct_s"),
        F.avg("summed").alias("mean_summed_s"),
    )
    middle = group_quantiles(gaps, ["_all"], "gap", {"median_overshoot_s": Quantile(0.5)})
    return basic.join(middle.drop("n"), "_all").drop("_all")


def ablation_by_segment(
    frame: DataFrame, cfg: CostConfig, axes: Sequence[str] = SEGMENT_COLUMNS, min_rows: int = MIN_SEGMENT_ROWS
) -> DataFrame:
    """Cost of direct and summed promises, overall and per bucket."""
    actual = F.col("actual")
    aggregates = [F.count("*").alias("rows")] + [
        F.avg(scores.business_cost(actual, F.col(name), cfg)).alias(f"{name}_cost") for name in ("direct", "summed")
    ]
    out = by_segment(frame, aggregates, axes)
    return out.filter((F.col("axis") == "global") | (F.col("rows") >= min_rows))


def attribution(
    contributions: DataFrame,
    families: DataFrame,
    axes: Sequence[str] = SEGMENT_COLUMNS,
    top: int = 5,
    min_rows: int = MIN_SEGMENT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Family shares and top features per segment bucket, from a long table row, feature, contribution, axes.

    Returns (axis, bucket, family, rows, share) and (axis, bucket, place, feature, mean_abs).
    """
    absolute = contributions.withColumn("_abs", F.abs("contribution"))
    means = by_segment(absolute, [F.count("*").alias("rows"), F.avg("_abs").alias("mean_abs")], axes, ["feature"])
    means = means.filter((F.col("axis") != "global") & (F.col("rows") >= min_rows))
    # From here on one row per bucket and feature.
    named = means.join(families, "feature")
    per_family = named.groupBy("axis", "bucket", "family").agg(
        F.max("rows").alias("rows"), F.sum("mean_abs").alias("mean_abs")
    )
    total = F.sum("mean_abs").over(Window.partitionBy("axis", "bucket"))
    shares = per_family.withColumn("share", F.coalesce(F.try_divide(F.col("mean_abs"), total), F.lit(0.0)))
    ranked = Window.partitionBy("axis", "bucket").orderBy(F.desc("mean_abs"), "feature")
    best = means.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= top)
    return shares.drop("mean_abs"), best.select("axis", "bucket", "place", "feature", "mean_abs")


def stage_percentiles(timings: DataFrame) -> DataFrame:
    """p50, p95, p99 and mean of ``ms`` per ``stage``."""
    wanted = {"p50": Quantile(0.5), "p95": Quantile(0.95), "p99": Quantile(0.99)}
    ranked = group_quantiles(timings, ["stage"], "ms", wanted)
    return ranked.join(timings.groupBy("stage").agg(F.avg("ms").alias("mean")), "stage")


def compare_predictions(left: DataFrame, right: DataFrame, key: str, tolerance: float = 1e-4) -> DataFrame:
    """Largest and mean absolute difference of two prediction columns, and the share within tolerance.

    Rows that only one side has are counted on their side and are not within tolerance.
    """
    mine = left.select(F.col(key).alias("_mine"), "prediction", F.lit(True).alias("_left"))
    renamed = right.select(F.col(key).alias("_key"), F.col("prediction").alias("_other"), F.lit(True).alias("_right"))
    pairs = mine.join(renamed, null_safe(mine, renamed, [("_mine", "_key")]), "full")
    gap = F.abs(F.col("prediction") - F.col("_other"))
    return pairs.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("_right").isNull()).alias("only_left"),
        F.count_if(F.col("_left").isNull()).alias("only_right"),
        F.max(gap).alias("max_abs_diff"),
        F.avg(gap).alias("mean_abs_diff"),
        scores.share(F.coalesce(gap <= tolerance, F.lit(False))).alias("share_within"),
    )
