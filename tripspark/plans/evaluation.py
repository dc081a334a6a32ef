"""Queries for scoring promises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripspark.functions import scores, vectors
from tripspark.operators.cleaning import component_complete
from tripspark.operators import evaluation as ev
from tripspark.plans.catalog import query
from tripspark.plans.reference import rounded, sql_rounded
from tripspark.plans.oracle import VIEWS
from tripspark.sources import driver_tables as d
from tripspark.vocab import SEGMENT_COLUMNS

COST = d.SETTINGS.cost
LEVELS = d.SETTINGS.model.levels
MIN_ROWS = 200

_LATE = "GREATEST(actual - {p}, 0) * 3 + GREATEST({p} - actual, 0)"
_METRICS = """COUNT(*) AS rows, AVG(GREATEST(actual - {p}, 0) * 3 + GREATEST({p} - actual, 0)) AS business_cost,
 AVG(ABS({p} - actual)) AS mae, SQRT(AVG(({p} - actual) * ({p} - actual))) AS rmse,
 AVG(CAST(actual > {p} AS INTEGER)) AS late_rate,
 AVG(GREATEST(CAST(0.75 AS DOUBLE) * (actual - {p}), CAST(-0.25 AS DOUBLE) * (actual - {p}))) AS pinball_at_q_star"""


def segment_union(select: str, frame: str, keys: str = "", having: int = MIN_ROWS) -> str:
    """The same aggregates for all rows and for each bucket of each axis."""
    key_list = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    parts = [f"SELECT {key_list}'global' AS axis, 'all' AS bucket, {select} FROM {frame} {group}"]
    for axis in SEGMENT_COLUMNS:
        parts.append(
            f"""SELECT {key_list}'{axis}' AS axis, {axis} AS bucket, {select} FROM {frame} WHERE {axis} IS NOT NULL
                GROUP BY {key_list}{axis} HAVING COUNT(*) >= {having}"""
        )
    return " UNION ALL ".join(parts)


def promises(spark: SparkSession, sf: str, splits=("test",)) -> DataFrame:
    """Scored trips with the served level as the promise."""
    return d.scored(spark, sf, splits).withColumn("promised", F.col("q")[d.SETTINGS.served_index])


def by_model_and_seed(frame: DataFrame) -> DataFrame:
    """Three candidate promises, each with three seeds that shift it a little."""
    candidates = F.array(
        F.struct(F.lit("served").alias("model"), F.col("q")[2].alias("p")),
        F.struct(F.lit("sorted").alias("model"), vectors.sort_row(F.col("q"))[2].alias("p")),
        F.struct(F.lit("baseline").alias("model"), F.col("baseline").alias("p")),
    )
    long = frame.withColumn("c", F.explode(candidates)).withColumn("seed", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    return long.withColumns(
        {"model": F.col("c.model"), "promised": F.col("c.p") + F.col("seed") * ((F.col("trip_id") % 5) - 1) * 10.0}
    )


VIEWS["candidates"] = """
SELECT s.*, c.model, c.seed, c.p + c.seed * ((s.trip_id % 5) - 1) * CAST(10 AS DOUBLE) AS promised
FROM scored_all s, LATERAL (
  SELECT model, p, seed FROM (VALUES ('served', s.q3), ('sorted', list_sort([s.q1, s.q2, s.q3, s.q4, s.q5])[3]),
    ('baseline', s.baseline)) m(model, p), (VALUES (0), (1), (2)) x(seed)) c"""
VIEWS["seed_results"] = f"""
SELECT model, seed, {_METRICS.format(p='promised')} FROM candidates WHERE split = 'test' GROUP BY 1, 2"""


@query(
    "row_costs",
    "P18 P19 P20",
    f"""SELECT trip_id, {_LATE.format(p='q3')} AS cost,
        ROUND(GREATEST(CAST(0.75 AS DOUBLE) * (actual - q3), CAST(-0.25 AS DOUBLE) * (actual - q3)), 4) AS pinball,
        CAST(actual > q3 AS INTEGER) AS late FROM scored""",
)
def row_costs(spark, sf):
    a, p = F.col("actual"), F.col("promised")
    return promises(spark, sf).select(
        "trip_id",
        scores.business_cost(a, p, COST).alias("cost"),
        F.round(scores.pinball(a, p, COST.optimal_quantile), 4).alias("pinball"),
        scores.is_late(a, p).cast("int").alias("late"),
    )


@query(
    "cost_optimal_level",
    "P29 P31",
    f"""SELECT level, ROUND(AVG(GREATEST(actual - p, 0) * 3 + GREATEST(p - actual, 0)), 4) AS cost,
        ROUND(4 * AVG(GREATEST(level * (actual - p), (level - 1) * (actual - p))), 4) AS scaled_pinball,
        CAST(ABS(level - 0.75) < 1e-9 AS INTEGER) AS is_served
        FROM scored, LATERAL (VALUES {", ".join(f"(CAST({a} AS DOUBLE), q{i})" for i, a in enumerate(LEVELS, 1))}) v(level, p)
        GROUP BY 1""",
)
def cost_optimal_level(spark, sf):
    """Cost of serving each level; at the optimal level pinball times the factor equals the cost."""
    parts = [
        F.struct(
            F.lit(level).alias("level"),
            F.col("q")[i].alias("p"),
            scores.pinball(F.col("actual"), F.col("q")[i], level).alias("loss"),
        )
        for i, level in enumerate(LEVELS)
    ]
    long = d.scored(spark, sf).select("actual", F.inline(F.array(*parts)))
    served = LEVELS[d.SETTINGS.served_index]
    return long.groupBy("level").agg(
        F.round(F.avg(scores.business_cost(F.col("actual"), F.col("p"), COST)), 4).alias("cost"),
        F.round(COST.pinball_factor * F.avg("loss"), 4).alias("scaled_pinball"),
    ).withColumn("is_served", (F.col("level") == served).cast("int"))


@query(
    "evaluation_by_segment",
    "A17",
    f"SELECT axis, bucket, rows, {sql_rounded(*ev.METRICS)} FROM ("
    + segment_union(_METRICS.format(p="q3"), "scored")
    + ")",
)
def evaluation_by_segment(spark, sf):
    out = ev.evaluate(promises(spark, sf), COST, min_rows=MIN_ROWS)
    return out.select("axis", "bucket", "rows", *rounded(*ev.METRICS))


_SPREAD = ", ".join(
    f"ROUND(AVG({m}), 4) AS {m}_mean, ROUND(COALESCE(stddev_samp({m}), 0), 4) AS {m}_std" for m in ev.METRICS
)


def seed_results(spark: SparkSession, sf: str) -> DataFrame:
    frame = by_model_and_seed(d.scored(spark, sf))
    return frame.groupBy("model", "seed").agg(*ev.metrics(COST)).withColumn("population", F.lit("test"))


@query(
    "seed_leaderboard",
    "A18 A19",
    f"""
WITH s AS (SELECT model, COUNT(*) AS seeds, MIN(rows) AS rows, AVG(business_cost) AS raw_cost, {_SPREAD}
           FROM seed_results GROUP BY 1)
SELECT * EXCLUDE (raw_cost), ROUND(100 * (raw_cost - (SELECT raw_cost FROM s WHERE model = 'baseline'))
       / (SELECT raw_cost FROM s WHERE model = 'baseline'), 4) AS vs_baseline_pct FROM s""",
)
def seed_leaderboard(spark, sf):
    board = ev.leaderboard(ev.summarise_seeds(seed_results(spark, sf)), "baseline")
    numbers = [f"{m}_{s}" for m in ev.METRICS for s in ("mean", "std")]
    return board.select("model", "seeds", "rows", *rounded(*numbers, "vs_baseline_pct"))


@query(
    "segment_table_over_seeds",
    "A20",
    "SELECT model, axis, bucket, MIN(rows) AS rows, ROUND(AVG(business_cost), 4) AS business_cost, ROUND(AVG(mae), 4) AS mae,"
    " ROUND(AVG(late_rate), 4) AS late_rate FROM ("
    + segment_union(_METRICS.format(p="promised"), "candidates", "model, seed, split")
    + ") WHERE axis <> 'global' AND split = 'test' GROUP BY 1, 2, 3",
)
def segment_table_over_seeds(spark, sf):
    results = ev.evaluate(by_model_and_seed(d.scored(spark, sf)), COST, keys=["model", "seed"], min_rows=MIN_ROWS)
    table = ev.segment_table(results.filter("axis <> 'global'"))
    return table.select("model", "axis", "bucket", "rows", *rounded("business_cost", "mae", "late_rate"))


@query(
    "validation_champion",
    "A27",
    f"""
WITH c AS (SELECT model, seed, AVG({_LATE.format(p='promised')}) AS cost FROM candidates WHERE split = 'val' GROUP BY 1, 2),
m AS (SELECT model, AVG(cost) AS val_cost, COALESCE(stddev_samp(cost), 0) AS val_cost_std FROM c GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY val_cost) AS place, LEAD(val_cost) OVER (ORDER BY val_cost) - val_cost AS margin
      FROM m)
SELECT model AS champion, ROUND(val_cost, 4) AS val_cost, ROUND(val_cost_std, 4) AS val_cost_std,
       ROUND(margin, 4) AS margin, CAST(margin > val_cost_std AS INTEGER) AS margin_exceeds_seed_spread
FROM r WHERE place = 1""",
)
def validation_champion(spark, sf):
    frame = by_model_and_seed(d.scored(spark, sf, ("val",)))
    cost = F.avg(scores.business_cost(F.col("actual"), F.col("promised"), COST)).alias("val_cost")
    chosen = ev.select_champion(frame.groupBy("model", "seed").agg(cost))
    return chosen.select(
        "champion",
        *rounded("val_cost", "val_cost_std", "margin"),
        F.col("margin_exceeds_seed_spread").cast("int").alias("margin_exceeds_seed_spread"),
    )


@query(
    "temporal_windows",
    "N4",
    f"""
WITH r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY request_s, trip_id) - 1 AS pos, COUNT(*) OVER () AS n FROM scored),
w AS (SELECT *, CASE WHEN pos < FLOOR(n / 3.0) THEN 'early' WHEN pos < FLOOR(2 * n / 3.0) THEN 'middle' ELSE 'late' END
      AS "window" FROM r)
SELECT "window", COUNT(*) AS rows, ROUND(AVG({_LATE.format(p='q3')}), 4) AS champion_cost,
       ROUND(AVG({_LATE.format(p='baseline')}), 4) AS baseline_cost,
       ROUND(AVG(CAST(actual > q3 AS INTEGER)), 4) AS champion_late,
       ROUND(AVG(CAST(actual > baseline AS INTEGER)), 4) AS baseline_late,
       ROUND(100 * (AVG({_LATE.format(p='q3')}) - AVG({_LATE.format(p='baseline')})) / AVG({_LATE.format(p='baseline')}), 4)
         AS improvement_pct
FROM w GROUP BY 1""",
)
def temporal_windows(spark, sf):
    numbers = ("champion_cost", "baseline_cost", "champion_late", "baseline_late", "improvement_pct")
    return ev.temporal_windows(promises(spark, sf), COST).select("window", "rows", *rounded(*numbers))


VIEWS["daily"] = f"""
SELECT request_local_s // 86400 AS day, AVG({_LATE.format(p='q3')} - ({_LATE.format(p='baseline')})) AS mean_diff,
       (request_local_s // 86400 + 3) % 7 AS weekday FROM scored GROUP BY 1, 3"""
_BLOCKS = ("mean_diff", "median_diff", "std_diff", "p10_diff", "p90_diff", "worst_block_diff", "best_block_diff",
           "weekday_diff", "weekend_diff")


@query(
    "paired_daily_blocks",
    "N6 N7",
    f"""
WITH runs AS (SELECT mean_diff, SUM(CAST(mean_diff < 0 AS INTEGER)) OVER (ORDER BY day) AS run FROM daily),
streak AS (SELECT COUNT(*) AS len FROM runs WHERE mean_diff >= 0 GROUP BY run)
SELECT blocks, champion_wins, (SELECT COALESCE(MAX(len), 0) FROM streak) AS longest_losing_streak,
       {sql_rounded(*_BLOCKS)}
FROM (SELECT COUNT(*) AS blocks, COUNT(*) FILTER (mean_diff < 0) AS champion_wins, AVG(mean_diff) AS mean_diff,
  median(mean_diff) AS median_diff, COALESCE(stddev_samp(mean_diff), 0) AS std_diff, quantile_cont(mean_diff, 0.1) AS p10_diff,
  quantile_cont(mean_diff, 0.9) AS p90_diff, MAX(mean_diff) AS worst_block_diff, MIN(mean_diff) AS best_block_diff,
  AVG(mean_diff) FILTER (weekday < 5) AS weekday_diff, AVG(mean_diff) FILTER (weekday >= 5) AS weekend_diff FROM daily)""",
)
def paired_daily_blocks(spark, sf):
    return ev.paired_blocks(promises(spark, sf), COST).select(
        "blocks", "champion_wins", "longest_losing_streak", *rounded(*_BLOCKS)
    )


# ---- quantile rows ---------------------------------------------------------------------------------------


@query(
    "quantile_row_repair",
    "P23 P24 P25",
    """SELECT trip_id, CAST(q1 <= q2 AND q2 <= q3 AND q3 <= q4 AND q4 <= q5 AS INTEGER) AS is_monotone,
              list_sort([q1, q2, q3, q4, q5])[3] AS sorted_p75, GREATEST(q1, q2, q3) AS raised_p75,
              GREATEST(q1, q2, q3, q4, q5) AS raised_p95 FROM scored""",
)
def quantile_row_repair(spark, sf):
    raised = vectors.running_max(F.col("q"))
    return d.scored(spark, sf).select(
        "trip_id",
        vectors.is_monotone(F.col("q")).cast("int").alias("is_monotone"),
        vectors.sort_row(F.col("q"))[2].alias("sorted_p75"),
        raised[2].alias("raised_p75"),
        raised[4].alias("raised_p95"),
    )


@query(
    "softplus_heads",
    "P26",
    """SELECT trip_id, ROUND(q1, 6) AS h1, ROUND(q1 + ln(1 + exp((q2 - q1) / 1000)), 6) AS h2,
       ROUND(q1 + ln(1 + exp((q2 - q1) / 1000)) + ln(1 + exp((q3 - q2) / 1000)), 6) AS h3 FROM scored""",
)
def softplus_heads(spark, sf):
    q = F.col("q")
    heads = vectors.ordered_heads(q[0], F.array((q[1] - q[0]) / 1000.0, (q[2] - q[1]) / 1000.0))
    return d.scored(spark, sf).select(
        "trip_id", *[F.round(heads[i], 6).alias(f"h{i + 1}") for i in range(3)]
    )


_PAIRS = [(f"{ev.level_name(a)}_over_{ev.level_name(b)}", i) for i, (a, b) in enumerate(zip(LEVELS, LEVELS[1:]), 1)]
_DROPS = " + ".join(f"GREATEST(q{i} - q{i + 1}, 0)" for i in range(1, 5))
_NDROPS = " + ".join(f"CAST(q{i} > q{i + 1} AS INTEGER)" for i in range(1, 5))


@query(
    "crossing_report",
    "A25",
    f"""SELECT COUNT(*) AS rows, COUNT(*) FILTER ({_NDROPS} > 0) AS crossing_rows,
        ROUND(AVG(CAST({_NDROPS} > 0 AS INTEGER)), 6) AS crossing_rate,
        {", ".join(f'ROUND(AVG(CAST(q{i} > q{i + 1} AS INTEGER)), 6) AS "{n}"' for n, i in _PAIRS)},
        MAX(GREATEST({", ".join(f"q{i} - q{i + 1}" for i in range(1, 5))}, 0)) AS worst_gap_s,
        ROUND(SUM({_DROPS}) / SUM({_NDROPS}), 4) AS mean_gap_s FROM scored""",
)
def crossing_report(spark, sf):
    out = ev.crossing_report(d.scored(spark, sf), LEVELS)
    return out.select(
        "rows", "crossing_rows", *rounded("crossing_rate", *[n for n, _ in _PAIRS], digits=6), "worst_gap_s",
        *rounded("mean_gap_s"),
    )


@query(
    "crossing_by_strategy",
    "A26",
    f"""
WITH s AS (SELECT seed, [q1, q2, q3 + seed * 300, q4, q5] AS q FROM scored, (VALUES (0), (1), (2)) x(seed)),
r AS (SELECT 'raw' AS strategy, seed, AVG(CAST(q <> list_sort(q) AS INTEGER)) AS rate,
        MAX(GREATEST(q[1] - q[2], q[2] - q[3], q[3] - q[4], q[4] - q[5], 0)) AS worst FROM s GROUP BY 2
      UNION ALL SELECT 'sorted', seed, 0, 0 FROM s GROUP BY 2)
SELECT strategy, COUNT(*) AS seeds, ROUND(AVG(rate), 6) AS rate_mean, ROUND(stddev_samp(rate), 6) AS rate_std,
       CAST(MAX(worst) AS DOUBLE) AS worst_gap_s FROM r GROUP BY 1""",
)
def crossing_by_strategy(spark, sf):
    q = F.col("q")
    seeded = d.scored(spark, sf).withColumn("seed", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    raw = seeded.withColumn("q", F.array(q[0], q[1], q[2] + F.col("seed") * 300.0, q[3], q[4]))
    both = raw.withColumn("strategy", F.lit("raw")).unionByName(
        raw.withColumns({"strategy": F.lit("sorted"), "q": vectors.sort_row(F.col("q"))})
    )
    out = ev.crossing_comparison(ev.crossing_report(both, LEVELS, ["strategy", "seed"]))
    return out.select("strategy", "seeds", *rounded("rate_mean", "rate_std", digits=6), "worst_gap_s")


_STEP_ROWS = " UNION ALL ".join(
    f"SELECT CAST({a} AS DOUBLE) AS level, q{i} - q{i - 1} AS step FROM scored" for i, a in enumerate(LEVELS, 1) if i > 1
)


def with_steps(frame: DataFrame) -> DataFrame:
    return frame.withColumn("steps", F.concat(F.slice("q", 1, 1), vectors.steps(F.col("q"))))


@query(
    "clamp_statistics",
    "A28",
    f"""SELECT level, COUNT(*) AS rows, COUNT(*) FILTER (step < 0) AS clamped_rows,
        ROUND(AVG(CAST(step < 0 AS INTEGER)), 6) AS clamped_share,
        ROUND(COALESCE(AVG(-step) FILTER (step < 0), 0), 4) AS mean_adjustment_s,
        ROUND(COALESCE(quantile_cont(-step, 0.95) FILTER (step < 0), 0), 4) AS p95_adjustment_s,
        COALESCE(MAX(-step) FILTER (step < 0), 0) AS max_adjustment_s FROM ({_STEP_ROWS}) GROUP BY 1""",
)
def clamp_statistics(spark, sf):
    out = ev.clamp_stats(with_steps(d.scored(spark, sf)), LEVELS)
    return out.select(
        "level", "rows", "clamped_rows", *rounded("clamped_share", digits=6),
        *rounded("mean_adjustment_s", "p95_adjustment_s"), "max_adjustment_s",
    )


@query(
    "clamped_and_untouched_cost",
    "A28",
    f"""SELECT CAST({_NDROPS} > 0 AS INTEGER) AS clamped, COUNT(*) AS rows, ROUND(AVG({_LATE.format(p='q3')}), 4) AS champion_cost,
        ROUND(AVG({_LATE.format(p='baseline')}), 4) AS baseline_cost,
        ROUND(100 * (AVG({_LATE.format(p='q3')}) - AVG({_LATE.format(p='baseline')})) / AVG({_LATE.format(p='baseline')}), 4)
          AS improvement_pct FROM scored GROUP BY 1""",
)
def clamped_and_untouched_cost(spark, sf):
    out = ev.clamp_split(with_steps(promises(spark, sf)), COST)
    return out.select(
        F.col("clamped").cast("int").alias("clamped"), "rows",
        *rounded("champion_cost", "baseline_cost", "improvement_pct"),
    )


# ---- comparisons -----------------------------------------------------------------------------------------

VIEWS["decomposed"] = """
SELECT *, q3 AS direct, q3 * CAST(0.2 AS DOUBLE) + q2 * CAST(0.05 AS DOUBLE) + q4 * CAST(0.7 AS DOUBLE) AS summed
FROM scored WHERE ABS(dispatch_approach_s + curb_wait_s + trip_duration_s - total_time_s) <= 1"""


def decomposed(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("q")
    return component_complete(d.scored(spark, sf)).withColumns(
        {"direct": q[2], "summed": q[2] * 0.2 + q[1] * 0.05 + q[3] * 0.7}
    )


@query(
    "component_overshoot",
    "A29",
    """SELECT COUNT(*) AS rows, ROUND(AVG(summed - direct), 4) AS mean_overshoot_s,
       ROUND(median(summed - direct), 4) AS median_overshoot_s,
       ROUND(AVG(CAST(summed - direct > 0 AS INTEGER)), 4) AS share_overshooting,
       ROUND(AVG(direct), 4) AS mean_direct_s, ROUND(AVG(summed), 4) AS mean_summed_s FROM decomposed""",
)
def component_overshoot(spark, sf):
    return ev.overshoot(decomposed(spark, sf)).select(
        "rows",
        *rounded("mean_overshoot_s", "median_overshoot_s", "share_overshooting", "mean_direct_s", "mean_summed_s"),
    )


@query(
    "component_cost_by_segment",
    "A29",
    f"SELECT axis, bucket, rows, {sql_rounded('direct_cost', 'summed_cost')} FROM ("
    + segment_union(
        f"COUNT(*) AS rows, AVG({_LATE.format(p='direct')}) AS direct_cost, AVG({_LATE.format(p='summed')}) AS summed_cost",
        "decomposed",
        having=100,
    )
    + ")",
)
def component_cost_by_segment(spark, sf):
    out = ev.ablation_by_segment(decomposed(spark, sf), COST, min_rows=100)
    return out.select("axis", "bucket", "rows", *rounded("direct_cost", "summed_cost"))


_FEATURE_FAMILIES = {
    "miles": "route", "hour": "temporal", "pickup": "zone", "dropoff": "zone", "dispatch": "congestion", "rain": "weather",
}


def contributions(spark: SparkSession, sf: str) -> DataFrame:
    """A long table of per-row feature contributions, as an explainer would write it."""
    parts = {
        "miles": F.col("trip_miles") * 20.0 - 100.0,
        "hour": ((F.col("request_local_s") % 86400) / 3600 - 12) * 4.0,
        "pickup": (F.col("pu_zone") - 13) * 3.0,
        "dropoff": (F.col("do_zone") - 13) * 2.0,
        "dispatch": (F.col("trip_id") % 101 - 50) * 1.0,
        "rain": F.coalesce(F.col("precip_mm_h").cast("double"), F.lit(0.0)) * 30.0,
    }
    long = F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("contribution")) for k, v in parts.items()]))
    return d.enriched(spark, sf).filter("split = 'test'").select("trip_id", *SEGMENT_COLUMNS, long)


VIEWS["contributions"] = """
SELECT t.*, c.feature, c.contribution FROM (SELECT * FROM enriched WHERE split = 'test') t, LATERAL (VALUES
  ('miles', t.trip_miles * 20 - 100), ('hour', ((t.request_local_s % 86400) / CAST(3600 AS DOUBLE) - 12) * 4),
  ('pickup', CAST((t.pu_zone - 13) * 3 AS DOUBLE)), ('dropoff', CAST((t.do_zone - 13) * 2 AS DOUBLE)),
  ('dispatch', CAST(t.trip_id % 101 - 50 AS DOUBLE)), ('rain', COALESCE(CAST(t.precip_mm_h AS DOUBLE), 0) * 30))
  c(feature, contribution)"""
VIEWS["mean_contributions"] = (
    "SELECT axis, bucket, feature, rows, mean_abs FROM ("
    + segment_union("COUNT(*) AS rows, AVG(ABS(contribution)) AS mean_abs", "contributions", "feature")
    + ") WHERE axis <> 'global'"
)


def _families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_FEATURE_FAMILIES.items()), "feature string, family string")


@query(
    "attribution_by_family",
    "A30",
    f"""
WITH f AS (SELECT axis, bucket, CASE feature {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FEATURE_FAMILIES.items())} END
           AS family, MAX(rows) AS rows, SUM(mean_abs) AS m FROM mean_contributions GROUP BY 1, 2, 3)
SELECT axis, bucket, family, rows, ROUND(m / SUM(m) OVER (PARTITION BY axis, bucket), 6) AS share FROM f""",
)
def attribution_by_family(spark, sf):
    shares, _ = ev.attribution(contributions(spark, sf), _families(spark), min_rows=MIN_ROWS)
    return shares.select("axis", "bucket", "family", "rows", *rounded("share", digits=6))


@query(
    "attribution_top_features",
    "A30 N9",
    """SELECT axis, bucket, CAST(place AS INTEGER) AS place, feature, ROUND(mean_abs, 6) AS mean_abs FROM (
       SELECT *, ROW_NUMBER() OVER (PARTITION BY axis, bucket ORDER BY mean_abs DESC, feature) AS place
       FROM mean_contributions) WHERE place <= 5""",
)
def attribution_top_features(spark, sf):
    _, best = ev.attribution(contributions(spark, sf), _families(spark), min_rows=MIN_ROWS)
    return best.select("axis", "bucket", "place", "feature", *rounded("mean_abs", digits=6))


@query(
    "stage_percentiles",
    "A31",
    """SELECT event_type AS stage, COUNT(*) AS n, ROUND(quantile_cont(value, 0.5), 6) AS p50,
       ROUND(quantile_cont(value, 0.95), 6) AS p95, ROUND(quantile_cont(value, 0.99), 6) AS p99,
       ROUND(AVG(value), 4) AS mean FROM events GROUP BY 1""",
)
def stage_percentiles(spark, sf):
    timings = d.table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    out = ev.stage_percentiles(timings)
    return out.select("stage", "n", *rounded("p50", "p95", "p99", digits=6), *rounded("mean"))


_SETS = """l AS (SELECT trip_id, q3 + CAST(0.1 AS DOUBLE) * (trip_id % 3) AS p FROM scored),
r AS (SELECT trip_id, CAST(CAST(q3 + CAST(0.1 AS DOUBLE) * (trip_id % 3) AS FLOAT) AS DOUBLE) AS p FROM scored_all
      WHERE split IN ('val', 'test') AND dispatch_approach_s IS NOT NULL AND curb_wait_s IS NOT NULL AND trip_duration_s IS NOT NULL
      AND ABS(dispatch_approach_s + curb_wait_s + trip_duration_s - total_time_s) <= 1)"""


@query(
    "prediction_set_difference",
    "A33",
    f"""WITH {_SETS}
       SELECT COUNT(*) AS rows, COUNT(*) FILTER (r.trip_id IS NULL) AS only_left, COUNT(*) FILTER (l.trip_id IS NULL) AS only_right,
       ROUND(MAX(ABS(l.p - r.p)), 6) AS max_abs_diff, ROUND(AVG(ABS(l.p - r.p)), 8) AS mean_abs_diff,
       ROUND(AVG(CAST(COALESCE(ABS(l.p - r.p) <= 1e-4, FALSE) AS INTEGER)), 6) AS share_within
       FROM l FULL JOIN r ON l.trip_id = r.trip_id""",
)
def prediction_set_difference(spark, sf):
    """Two whole prediction sets: the test trips in double precision, and the component-complete trips of validation and
    test in single precision, as a compiled component model would score them."""
    prediction = (F.col("promised") + 0.1 * (F.col("trip_id") % 3)).alias("prediction")
    left = promises(spark, sf).select("trip_id", prediction)
    right = component_complete(promises(spark, sf, ("val", "test"))).select("trip_id", prediction)
    right = right.withColumn("prediction", F.col("prediction").cast("float").cast("double"))
    out = ev.compare_predictions(left, right, "trip_id")
    return out.select(
        "rows", "only_left", "only_right", *rounded("max_abs_diff", digits=6), F.round("mean_abs_diff", 8).alias("mean_abs_diff"),
        *rounded("share_within", digits=6),
    )
