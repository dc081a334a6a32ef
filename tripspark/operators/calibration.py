"""Coverage by segment and its repair: isotonic maps, split-conformal and segment-conditional intervals.

Frames carry ``actual``, an ascending-level array ``q``, the segment columns and, where several runs are treated
at once, key columns such as ``seed``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tripspark.config import Settings
from tripspark.functions import scores, vectors
from tripspark.operators.evaluation import by_segment
from tripspark.operators.lookups import null_safe
from tripspark.operators.orderstats import Quantile, group_quantiles, row_edges, slice_of
from tripspark.session import materialize
from tripspark.vocab import MIN_SEGMENT_ROWS, REQUEST_TIME_SEGMENTS, SEGMENT_COLUMNS

ALL = "*"


# ---- coverage --------------------------------------------------------------------------------------------


def _gap_pp() -> Column:
    return (F.col("empirical") - F.col("nominal")) * 100.0


def coverage_report(
    frame: DataFrame,
    levels: Sequence[float],
    axes: Sequence[str] = SEGMENT_COLUMNS,
    keys: Sequence[str] = (),
    min_rows: int = MIN_SEGMENT_ROWS,
) -> DataFrame:
    """Share of actuals at or under each level, overall and per bucket: all levels in one pass over the rows."""
    shares = [scores.share(F.col("actual") <= F.col("q")[i]).alias(f"_c{i}") for i in range(len(levels))]
    wide = by_segment(frame, [F.count("*").alias("rows"), *shares], axes, keys)
    wide = wide.filter((F.col("axis") == "global") | (F.col("rows") >= min_rows))
    points = F.inline(
        F.array(
            *[
                F.struct(F.lit(float(level)).alias("nominal"), F.col(f"_c{i}").alias("empirical"))
                for i, level in enumerate(levels)
            ]
        )
    )
    return wide.select(*keys, "axis", "bucket", "rows", points).withColumn("gap_pp", _gap_pp())


def interval_coverage(
    frame: DataFrame,
    target: float,
    axes: Sequence[str] = SEGMENT_COLUMNS,
    keys: Sequence[str] = (),
    min_rows: int = MIN_SEGMENT_ROWS,
) -> DataFrame:
    """Coverage of [lo, hi] per bucket and overall, with the mean width."""
    inside = scores.covers(F.col("actual"), F.col("lo"), F.col("hi"))
    out = by_segment(
        frame,
        [
            F.count("*").alias("rows"),
            scores.share(inside).alias("empirical"),
            F.avg(F.col("hi") - F.col("lo")).alias("mean_width_s"),
        ],
        axes,
        keys,
    )
    out = out.filter((F.col("axis") == "global") | (F.col("rows") >= min_rows))
    return out.withColumn("nominal", F.lit(float(target))).withColumn("gap_pp", _gap_pp())


def worst_segment(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The bucket furthest from its level by absolute gap, next to the aggregate gap."""
    segment = F.col("axis") != "global"
    size = F.abs("gap_pp")
    worst = F.max_by(
        F.struct("axis", "bucket", "gap_pp"),
        F.when(segment, F.struct(size.alias("size"), F.col("axis"), F.col("bucket"))),
    )
    out = points.groupBy(*keys).agg(
        worst.alias("w"), F.max(F.when(~segment, size)).alias("aggregate_gap_pp")
    )
    return out.select(
        *keys,
        "aggregate_gap_pp",
        F.abs("w.gap_pp").alias("worst_gap_pp"),
        F.concat_ws("=", "w.axis", "w.bucket").alias("worst_segment"),
    )


# ---- cells and their margins -----------------------------------------------------------------------------


def _margin_id(gid: Column, axes: Sequence[Column]) -> Column:
    """Text key of a margin: which axes are dropped, then the bucket of each kept axis."""
    return F.concat_ws("|", gid.cast("string"), *[F.coalesce(a, F.lit("<none>")) for a in axes])


def _masked(axes: Sequence[str], gid: Column) -> list[Column]:
    """Axis values with the dropped ones blanked; the first axis is the highest bit."""
    out = []
    for i, axis in enumerate(axes):
        bit = 1 << (len(axes) - 1 - i)
        out.append(F.when(gid.bitwiseAND(F.lit(bit)) == 0, F.coalesce(F.col(axis), F.lit("<null>"))))
    return out


def margin_counts(frame: DataFrame, axes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows of every combination of kept and dropped axes; ``gid`` tells a dropped axis from a null bucket."""
    sets = [
        [a for i, a in enumerate(axes) if not gid >> (len(axes) - 1 - i) & 1] for gid in range(1 << len(axes))
    ]
    gid = reduce(
        lambda x, y: x + y, (F.grouping(a).cast("int") * (1 << (len(axes) - 1 - i)) for i, a in enumerate(axes))
    )
    return frame.groupingSets([[F.col(c) for c in [*keys, *s]] for s in sets], *keys, *axes).agg(
        gid.alias("gid"), F.count("*").alias("n")
    )


def cell_plan(frame: DataFrame, axes: Sequence[str], floor: int, keys: Sequence[str] = ()) -> DataFrame:
    """For each observed cell the margin that serves it: the cell itself if it has enough rows, else the margin
    that keeps most axes, ties in axis order, else everything.

    Columns keys, axes, cell_rows, gid, margin, n. A cell has at most 2^axes margins, so this stays small.
    """
    counts = margin_counts(frame, axes, keys)
    everything = (1 << len(axes)) - 1
    margins = counts.select(
        *[F.col(k).alias(f"_m_{k}") for k in keys],
        _margin_id(F.col("gid"), _masked(axes, F.col("gid"))).alias("_margin"),
        F.col("n").alias("_n"),
    )
    cells = counts.filter("gid = 0").select(*keys, *axes, F.col("n").alias("cell_rows"))
    masks = F.explode(F.sequence(F.lit(0), F.lit(everything)))
    asked = cells.withColumn("gid", masks)
    asked = asked.withColumn("margin", _margin_id(F.col("gid"), _masked(axes, F.col("gid"))))
    pairs = [(k, f"_m_{k}") for k in keys] + [("margin", "_margin")]
    found = asked.join(margins, null_safe(asked, margins, pairs))
    able = found.filter((F.col("_n") >= floor) | (F.col("gid") == everything))
    order = F.struct(F.bit_count("gid"), "gid")
    return able.groupBy(*keys, *axes).agg(
        F.max("cell_rows").alias("cell_rows"),
        F.min_by("gid", order).alias("gid"),
        F.min_by("margin", order).alias("margin"),
        F.min_by("_n", order).alias("n"),
    )


def plan_summary(plan: DataFrame, n_axes: int, keys: Sequence[str] = ()) -> DataFrame:
    everything = (1 << n_axes) - 1
    return plan.groupBy(*keys).agg(
        F.count("*").alias("cells"),
        F.count_if(F.col("gid") == 0).alias("exact"),
        F.count_if((F.col("gid") > 0) & (F.col("gid") < everything)).alias("fell_back"),
        F.count_if(F.col("gid") == everything).alias("global_fallback"),
    )


# ---- conformal intervals ---------------------------------------------------------------------------------


def with_bounds(frame: DataFrame, settings: Settings) -> DataFrame:
    lo, hi = settings.interval_indexes
    return frame.withColumns({"lo": F.col("q")[lo], "hi": F.col("q")[hi]})


def with_scores(frame: DataFrame) -> DataFrame:
    return frame.withColumn("score", scores.conformity(F.col("actual"), F.col("lo"), F.col("hi")))


def split_conformal(cal: DataFrame, risk: float, keys: Sequence[str] = ()) -> DataFrame:
    """One widening per key: the conformal order statistic of the calibration scores. Columns keys, q_s, n.

    Without calibration rows nothing bounds the error and the widening is infinite; :func:`apply_split` gives the same
    to keys that have no row here.
    """
    out = group_quantiles(
        with_scores(cal), list(keys), "score", {"q_s": Quantile(risk, "conformal")}
    )
    if not keys:
        out = out.agg(F.coalesce(F.max("q_s"), F.lit(math.inf)).alias("q_s"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    return materialize(out.select(*keys, "q_s", "n"), "split-widths")


def mondrian_conformal(
    cal: DataFrame, risk: float, axes: Sequence[str], floor: int, keys: Sequence[str] = ()
) -> DataFrame:
    """One widening per observed cell, from the scores of all rows in the margin that serves it.

    Scores are counted per cell and value first; those counts go to the margins that serve some cell, and to no
    other, so the rows themselves are never multiplied. Columns keys, axes, cell_rows, gid, n, q_s.
    """
    plan = materialize(cell_plan(cal, axes, floor, keys), "cell-plan")
    needed = plan.select(*keys, F.col("margin").alias("_needed")).distinct()
    everything = (1 << len(axes)) - 1
    members = plan.select(*keys, *axes).withColumn("gid", F.explode(F.sequence(F.lit(0), F.lit(everything))))
    members = members.withColumn("margin", _margin_id(F.col("gid"), _masked(axes, F.col("gid"))))
    wanted = needed.withColumnsRenamed({k: f"_w_{k}" for k in keys})
    on = [(k, f"_w_{k}") for k in keys] + [("margin", "_needed")]
    members = members.join(wanted, null_safe(members, wanted, on)).select(*keys, *axes, "margin")
    counts = with_scores(cal).groupBy(*keys, *axes, "score").agg(F.count("*").alias("_rows"))
    pooled = _join_cells(counts, members, axes, keys, "inner").select(*keys, "margin", "score", "_rows")
    widths = group_quantiles(
        pooled, [*keys, "margin"], "score", {"q_s": Quantile(risk, "conformal")}, weight="_rows"
    ).select(*[F.col(k).alias(f"_q_{k}") for k in keys], F.col("margin").alias("_q_margin"), "q_s")
    on = [(k, f"_q_{k}") for k in keys] + [("margin", "_q_margin")]
    joined = plan.join(widths, null_safe(plan, widths, on))
    return materialize(joined.select(*keys, *axes, "cell_rows", "gid", "n", "q_s"), "cell-widths")


def _join_cells(
    frame: DataFrame, table: DataFrame, axes: Sequence[str], keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Null-safe join on the segment cell. The tables of cells are written, so the planner broadcasts by size."""
    on = [*keys, *axes]
    others = [c for c in table.columns if c not in on]
    small = table.select(*[F.col(c).alias(f"_j_{c}") for c in on], *others)
    joined = frame.join(small, null_safe(frame, small, [(c, f"_j_{c}") for c in on]), how)
    return joined.drop(*[f"_j_{c}" for c in on])


def apply_split(frame: DataFrame, widening: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Widen [lo, hi] on both sides."""
    if keys:
        joined = _join_cells(frame, widening.select(*keys, "q_s"), (), keys)
    else:
        joined = frame.withColumn("q_s", widening.select("q_s").scalar())
    return _widen(joined.withColumn("q_s", F.coalesce("q_s", F.lit(math.inf))))


def apply_mondrian(
    frame: DataFrame, cells: DataFrame, overall: DataFrame, axes: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Widen by the cell's own amount; a cell never seen in calibration takes the overall amount."""
    table = cells.select(*keys, *axes, F.col("q_s").alias("cell_q"))
    joined = _join_cells(frame, table, axes, keys)
    whole = overall.select(*keys, F.col("q_s").alias("all_q"))
    if keys:
        joined = _join_cells(joined, whole, (), keys)
    else:
        joined = joined.withColumn("all_q", whole.scalar())
    return _widen(joined.withColumn("q_s", F.coalesce("cell_q", "all_q", F.lit(math.inf))).drop("cell_q", "all_q"))


def _widen(frame: DataFrame) -> DataFrame:
    return frame.withColumns({"lo": F.col("lo") - F.col("q_s"), "hi": F.col("hi") + F.col("q_s")}).drop("q_s")


# ---- isotonic maps ---------------------------------------------------------------------------------------


def _pool_adjacent(maps: DataFrame) -> DataFrame:
    """Adds ``ys``, the increasing fit of ``points`` (x, y, w) sorted by x: at each point the largest, over starts
    at or before it, of the smallest weighted mean over ends at or after it. A map has at most 20 points."""
    n = F.size("points")

    def totals(term) -> Column:
        return F.transform(
            F.sequence(F.lit(0), n),
            lambda upto: F.aggregate(F.slice("points", F.lit(1), upto), F.lit(0.0), lambda s, p: s + term(p)),
        )

    summed = maps.withColumns({"_wy": totals(lambda p: p["y"] * p["w"]), "_w": totals(lambda p: p["w"])})

    def mean(a: Column, b: Column) -> Column:
        return (F.element_at("_wy", b + 1) - F.element_at("_wy", a)) / (F.element_at("_w", b + 1) - F.element_at("_w", a))

    def lowest(a: Column, i: Column) -> Column:
        return F.array_min(F.transform(F.sequence(i, n), lambda b: mean(a, b)))

    fit = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.array_max(F.transform(F.sequence(F.lit(1), i), lambda a: lowest(a, i))),
    )
    return summed.withColumn("ys", fit).drop("_wy", "_w")


def interpolate(xs: Column, ys: Column, value: Column) -> Column:
    """Piecewise-linear through (xs, ys), flat outside."""
    n = F.size(xs)
    i = F.size(F.filter(xs, lambda x: x <= value))
    at = F.greatest(F.least(i, n - 1), F.lit(1))
    x0, x1 = F.element_at(xs, at), F.element_at(xs, F.least(at + 1, n))
    y0, y1 = F.element_at(ys, at), F.element_at(ys, F.least(at + 1, n))
    inside = y0 + (y1 - y0) * (value - x0) / F.nullif(x1 - x0, F.lit(0.0))
    return (
        F.when(value.isNull(), None)
        .when(i <= 0, F.element_at(ys, 1))
        .when(i >= n, F.element_at(ys, -1))
        .otherwise(inside)
    )


#: Rows of one map that one task may fit in memory; a larger one is fitted from counts.
MOST_FITTED = 200_000


def fit_isotonic(
    cal: DataFrame,
    levels: Sequence[float],
    axes: Sequence[str],
    min_rows: int,
    *,
    tie: str = "trip_id",
    bins: int = 20,
    min_bin_rows: int = 20,
    keys: Sequence[str] = (),
    most: int = MOST_FITTED,
) -> DataFrame:
    """Increasing maps per axis bucket and level, and overall (axis and bucket ``*``).

    Columns keys, axis, bucket, level, xs, ys, rows.
    Rows are cut into equal-count bins by prediction; a bin gives its median prediction and the shift that makes
    its coverage exact. Buckets with few rows get no map of their own. A map with under two points is left out.
    Equal predictions are split by the id column.

    Sizes come from the rows as they are. All maps of up to ``most`` rows are fitted in one job, a task per map; larger
    ones by order statistics that never gather a map's rows. Both give the same maps.
    """
    own = [F.struct(F.lit(a).alias("axis"), F.col(a).alias("bucket")) for a in axes]
    whole = F.struct(F.lit(ALL).alias("axis"), F.lit(ALL).alias("bucket"))
    spread = cal.select(*keys, "actual", F.col(tie).alias("_tie"), "q", F.inline(F.array(whole, *own)))
    spread = spread.filter("bucket IS NOT NULL")
    cells = [*keys, "axis", "bucket"]
    sizes = materialize(spread.groupBy(*cells).agg(F.count("*").alias("_size")), "isotonic-sizes")
    wanted = sizes.filter((F.col("bucket") == ALL) | (F.col("_size") >= min_rows))
    per_level = F.array(
        *[F.struct(F.lit(float(a)).alias("level"), F.col("q")[i].alias("pred")) for i, a in enumerate(levels)]
    )

    def rows_of(chosen: DataFrame) -> DataFrame:
        named = chosen.select(*[F.col(c).alias(f"_c_{c}") for c in cells])
        held = spread.join(named, null_safe(spread, named, [(c, f"_c_{c}") for c in cells]), "left_semi")
        return held.select(*keys, "actual", "_tie", "axis", "bucket", F.inline(per_level))

    small, large = wanted.filter(F.col("_size") <= most), wanted.filter(F.col("_size") > most)
    fitted = _fit_in_tasks(rows_of(small), [*cells, "level"], min_rows, bins, min_bin_rows)
    if not large.isEmpty():
        fitted = fitted.unionByName(_fit_by_counts(rows_of(large), [*cells, "level"], min_rows, bins, min_bin_rows))
    return materialize(fitted, "isotonic-maps")


def _linear_quantile(ordered: np.ndarray, level: float) -> float:
    position = (len(ordered) - 1) * level
    low = ordered[int(np.floor(position))]
    return float(low + (ordered[int(np.ceil(position))] - low) * (position - np.floor(position)))


def pool_adjacent(y: Sequence[float], weight: Sequence[float]) -> list[float]:
    """The increasing fit of values in order: neighbours that fall are pooled into their weighted mean."""
    pools: list[list[float]] = []
    for value, w in zip(y, weight, strict=True):
        pools.append([value, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            value, w, n = pools.pop()
            before = pools[-1]
            before[0] = (before[0] * before[1] + value * w) / (before[1] + w)
            before[1] += w
            before[2] += n
    return [mean for mean, _, n in pools for _ in range(int(n))]


def _fit_in_tasks(rows: DataFrame, groups: Sequence[str], min_rows: int, bins: int, min_bin_rows: int) -> DataFrame:
    """Maps of groups that fit into a task."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{g}` {kinds[g]}" for g in groups) + ", xs array<double>, ys array<double>, rows bigint"
    names = [*groups, "xs", "ys", "rows"]

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part[part["pred"].notna()].sort_values(["pred", "_tie"], kind="stable")
        n, level, bucket = len(part), key[groups.index("level")], key[groups.index("bucket")]
        count = int(min(bins, max(n // 200, 2)))
        pred, residual = part["pred"].to_numpy(float), (part["actual"] - part["pred"]).to_numpy(float)
        points: dict[float, list[float]] = {}
        for i in range(count):
            lo, hi = i * n // count, (i + 1) * n // count
            known = np.sort(residual[lo:hi][~np.isnan(residual[lo:hi])])
            if hi - lo >= min_bin_rows and len(known):
                x = _linear_quantile(pred[lo:hi], 0.5)
                points.setdefault(x, []).append(x + _linear_quantile(known, level))
        if sum(map(len, points.values())) < 2 or (bucket != ALL and n < min_rows):
            return pd.DataFrame(columns=names)
        xs = sorted(points)
        ys = pool_adjacent([float(np.mean(points[x])) for x in xs], [float(len(points[x])) for x in xs])
        return pd.DataFrame([(*key, xs, ys, n)], columns=names)

    return rows.groupBy(*groups).applyInPandas(fit, schema)


def _fit_by_counts(long: DataFrame, groups: Sequence[str], min_rows: int, bins: int, min_bin_rows: int) -> DataFrame:
    """The same maps by order statistics; the small tables between the steps are written, so each step's plan starts
    from a table and not from all steps before it."""
    long = materialize(long, "isotonic-rows")

    def parts(n: Column) -> Column:
        return F.least(F.lit(bins), F.greatest(F.floor(n / 200.0), F.lit(2)))

    edges = materialize(
        row_edges(long, groups, "pred", "_tie", parts), "isotonic-edges"
    )
    renamed = edges.select(*[F.col(g).alias(f"_b_{g}") for g in groups], "edges")
    # One row per axis bucket and level.
    cut = long.join(renamed, null_safe(long, renamed, [(g, f"_b_{g}") for g in groups]))
    cut = cut.select(
        *groups,
        "pred",
        slice_of(F.col("edges"), F.col("pred"), F.col("_tie"), bins).alias("bin"),
        (F.col("actual") - F.col("pred")).alias("residual"),
    )
    cut = materialize(cut, "isotonic-cut")
    binned = [*groups, "bin"]
    centre = group_quantiles(cut, binned, "pred", {"x": Quantile(0.5)})
    shift = group_quantiles(cut, binned, "residual", {"shift": Quantile("level")})
    points = materialize(centre.join(shift.drop("n"), binned), "isotonic-points")
    sizes = points.groupBy(*groups).agg(F.sum("n").alias("rows"))
    usable = points.filter(F.col("n") >= min_bin_rows)
    # Bins with the same centre count as one point with their mean.
    merged = usable.groupBy(*groups, "x").agg(
        F.avg(F.col("x") + F.col("shift")).alias("y"), F.count("*").cast("double").alias("w")
    )
    maps = merged.groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct("x", "y", "w"))).alias("points"), F.sum("w").alias("bins")
    )
    maps = maps.filter(F.col("bins") >= 2).join(sizes, groups)
    maps = maps.filter((F.col("bucket") == ALL) | (F.col("rows") >= min_rows))
    return _pool_adjacent(maps).select(*groups, F.col("points.x").alias("xs"), "ys", "rows")


def apply_isotonic(
    frame: DataFrame, maps: DataFrame, levels: Sequence[float], axis: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Map each level through its bucket's curve, or the overall one, then restore the order of the levels."""
    per_bucket = maps.filter(F.col("axis").isin(ALL, axis)).groupBy(*keys, "bucket").agg(
        F.map_from_entries(F.collect_list(F.struct("level", F.struct("xs", "ys")))).alias("curves")
    )
    own = per_bucket.filter(F.col("bucket") != ALL).withColumnsRenamed({"bucket": axis, "curves": "own"})
    whole = per_bucket.filter(F.col("bucket") == ALL).select(*keys, F.col("curves").alias("whole"))
    joined = _join_cells(frame, own, [axis], keys)
    if keys:
        joined = _join_cells(joined, whole, (), keys)
    else:
        joined = joined.withColumn("whole", whole.scalar())
    corrected = []
    for i, level in enumerate(levels):
        key = F.lit(float(level))
        curve = F.coalesce(F.try_element_at("own", key), F.try_element_at("whole", key))
        value = F.col("q")[i]
        corrected.append(F.coalesce(interpolate(curve["xs"], curve["ys"], value), value))
    return joined.withColumn("_q", F.array(*corrected)).withColumn("q", vectors.running_max(F.col("_q"))).drop(
        "_q", "own", "whole"
    )


# ---- the whole run ---------------------------------------------------------------------------------------


def measure(
    frame: DataFrame, approach: str, settings: Settings, keys: Sequence[str], min_rows: int = MIN_SEGMENT_ROWS
) -> DataFrame:
    """One row per key, from one pass: point gaps at the served level, interval gaps, coverage and width."""
    level, target = settings.model.levels[settings.served_index], settings.calibration.target_coverage
    actual = F.col("actual")
    table = by_segment(
        frame,
        [
            F.count("*").alias("rows"),
            scores.share(actual <= F.col("q")[settings.served_index]).alias("point"),
            scores.share(scores.covers(actual, F.col("lo"), F.col("hi"))).alias("band"),
            F.avg(F.col("hi") - F.col("lo")).alias("width"),
        ],
        keys=keys,
    )
    table = table.filter((F.col("axis") == "global") | (F.col("rows") >= min_rows)).withColumns(
        {"point_gap": F.abs(F.col("point") - level) * 100.0, "band_gap": F.abs(F.col("band") - target) * 100.0}
    )
    whole = F.col("axis") == "global"

    def worst(gap: str) -> Column:
        return F.max(F.when(~whole, F.struct(F.col(gap).alias("gap"), F.col("axis"), F.col("bucket"))))

    out = table.groupBy(*keys).agg(
        F.max(F.when(whole, F.col("point_gap"))).alias("aggregate_gap_pp"),
        worst("point_gap").alias("wp"),
        worst("band_gap").alias("wb"),
        F.max(F.when(whole, F.col("band"))).alias("interval_coverage"),
        F.max(F.when(whole, F.col("width"))).alias("mean_width_s"),
    )
    return out.select(
        F.lit(approach).alias("approach"),
        *keys,
        "aggregate_gap_pp",
        F.col("wp.gap").alias("worst_point_gap_pp"),
        F.concat_ws("=", "wp.axis", "wp.bucket").alias("worst_point_segment"),
        F.col("wb.gap").alias("worst_interval_gap_pp"),
        F.concat_ws("=", "wb.axis", "wb.bucket").alias("worst_interval_segment"),
        "mean_width_s",
        "interval_coverage",
    )


def calibration_run(
    cal: DataFrame,
    test: DataFrame,
    settings: Settings,
    keys: Sequence[str] = ("seed",),
    mondrian_axes: Sequence[str] = REQUEST_TIME_SEGMENTS,
    isotonic_axes: Sequence[str] = SEGMENT_COLUMNS,
    min_rows: int = MIN_SEGMENT_ROWS,
) -> DataFrame:
    """Fit every repair on the calibration rows, score it on the test rows; all seeds in one job per repair."""
    levels, floor = settings.model.levels, settings.calibration.min_cell_rows
    risk = settings.calibration.risk
    cal_band, test_band = with_bounds(cal, settings), with_bounds(test, settings)
    runs = [measure(test_band, "raw", settings, keys, min_rows)]
    maps = None
    if isotonic_axes:
        maps = fit_isotonic(cal, levels, isotonic_axes, floor, keys=keys)
    for axis in isotonic_axes:
        adjusted = with_bounds(apply_isotonic(test, maps, levels, axis, keys), settings)
        runs.append(measure(adjusted, f"isotonic[{axis}]", settings, keys, min_rows))
    overall = split_conformal(cal_band, risk, keys)
    runs.append(measure(apply_split(test_band, overall, keys), "cqr", settings, keys, min_rows))
    cells = mondrian_conformal(cal_band, risk, mondrian_axes, floor, keys)
    conditional = apply_mondrian(test_band, cells, overall, mondrian_axes, keys)
    runs.append(measure(conditional, "cqr_mondrian", settings, keys, min_rows))
    return reduce(DataFrame.unionByName, runs)


def summarise_run(run: DataFrame) -> DataFrame:
    """Per approach over seeds: mean gaps, spread of the interval gap, the most frequent worst segment, width."""
    segment_counts = run.groupBy("approach", "worst_interval_segment").agg(F.count("*").alias("times"))
    ranked = Window.partitionBy("approach").orderBy(F.desc("times"), "worst_interval_segment")
    modal = segment_counts.withColumn("place", F.row_number().over(ranked)).filter("place = 1")
    means = run.groupBy("approach").agg(
        F.count("*").alias("seeds"),
        F.avg("aggregate_gap_pp").alias("aggregate_gap_pp"),
        F.avg("worst_point_gap_pp").alias("worst_point_gap_pp"),
        F.avg("worst_interval_gap_pp").alias("worst_interval_gap_pp"),
        F.coalesce(F.stddev_samp("worst_interval_gap_pp"), F.lit(0.0)).alias("worst_interval_gap_std"),
        F.avg("interval_coverage").alias("interval_coverage"),
        F.avg("mean_width_s").alias("mean_width_s"),
    )
    return means.join(modal.select("approach", F.col("worst_interval_segment").alias("worst_segment")), "approach")
