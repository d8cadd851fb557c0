"""Distributions per arm: percentiles, histograms, rates by engagement level, dwell-time buckets."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import avg_d, pct, rnd
from ..spec import DEFAULT_SPEC, PERCENTILES, TIME_BUCKETS, WIDGET_BINS, Bin, ExperimentSpec
from .clean import normal
from .common import share_of

# Metrics of the percentile report, (label, clean column), in report order.
DISTRIBUTION_METRICS = (
    ("Page Load Time", "page_load_time_clean"),
    ("Time on Dashboard", "time_on_dashboard_clean"),
    ("Widgets Viewed", "widgets_viewed"),
)

_PCT_NAMES = {0.10: "p10", 0.25: "p25", 0.50: "p50_median", 0.75: "p75", 0.90: "p90", 0.95: "p95"}


def binned(c: str | Column, bins: Sequence[Bin]) -> Column:
    """Label of the first matching bin; the last bin (no bounds) catches the rest, NULL included."""
    x = F.col(c) if isinstance(c, str) else c
    expr = None
    for b in bins:
        if b.lo is None and b.hi is None:
            return F.lit(b.label) if expr is None else expr.otherwise(F.lit(b.label))
        if b.closed:
            cond = x.between(b.lo, b.hi) if b.lo != b.hi else (x == b.lo)
        else:
            cond = (x < b.hi) if b.lo is None else ((x >= b.lo) & (x < b.hi) if b.hi is not None else x >= b.lo)
        expr = F.when(cond, F.lit(b.label)) if expr is None else expr.when(cond, F.lit(b.label))
    return expr


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[tuple[str, str]],
    probs: Sequence[float],
    ranges: int = 16,
) -> DataFrame:
    """Exact percentiles (linear interpolation, as ``percentile``) and means per key and metric.

    Distributed selection. A ``percentile`` aggregate merges every task's value->count map for a
    group in one reducer task, and a window by group sorts it in one; with two arms that is
    two tasks for the whole table, however many values a metric has. Instead:

    1. the value histogram is an ordinary aggregation keyed by (key, metric, value), spread
       over all reducers;
    2. approximate quantiles of its values cut each group into ``ranges`` ranges of about
       equally many distinct values;
    3. the ranges' row counts, at most ``ranges`` numbers a group, give by prefix sum how
       many rows lie below each range, and so which ranges hold the wanted ranks;
    4. only those ranges' values are sorted, each range by itself, to find the ranks in it.

    The cuts only decide who sorts what: results are exact wherever they fall. Cuts and wanted
    ranks are broadcast: a few numbers for each group that the report itself prints.

    Output: ``keys``, ``metric`` (label), ``n``, ``q`` (array, one entry per prob), ``mean``.
    """
    part = [*keys, "metric"]
    stack_args = ", ".join(f"'{label}', CAST({c} AS DOUBLE)" for label, c in metrics)
    long = df.select(*keys, F.expr(f"stack({len(metrics)}, {stack_args}) AS (metric, value)")).filter(
        F.col("value").isNotNull()
    )
    hist = long.groupBy(*part, "value").agg(F.count("*").alias("c"))

    def beside(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
        """``left`` with the columns of the few rows of ``right``; NULL keys meet."""
        named = right.select(*[F.col(c).alias(f"_{c}") if c in on else F.col(c) for c in right.columns])
        same = functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])
        return left.join(F.broadcast(named), same).drop(*[f"_{c}" for c in on])

    # the cuts name the count too, so that all readers of the histogram share one exchange
    cuts = F.percentile_approx(F.when(F.col("c") > 0, F.col("value")), [i / ranges for i in range(1, ranges)], 16 * ranges)
    cut = beside(hist, hist.groupBy(*part).agg(cuts.alias("_cuts")), part)

    def place(lo: int, hi: int) -> str:
        """How many cuts lie below the value, ``lo`` to ``hi`` of them: a binary search."""
        mid = (lo + hi) // 2
        return str(lo) if lo == hi else f"CASE WHEN _cuts[{mid}] < value THEN {place(mid + 1, hi)} ELSE {place(lo, mid)} END"

    ranged = cut.withColumn("_range", F.expr(place(0, ranges - 1))).drop("_cuts")
    # rows of each range, and the wanted ranks: both ends of each prob's position
    per_range = ranged.groupBy(*part, "_range").agg(F.sum("c").alias("c"), F.sum(F.col("value") * F.col("c")).alias("s"))
    group = per_range.groupBy(*part).agg(
        F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("mean"), F.array_sort(F.collect_list(F.struct("_range", "c"))).alias("_counts")
    )
    ranks = []
    for p in probs:
        pos = F.lit(float(p)) * (F.col("n") - 1).cast("double")
        ranks += [F.floor(pos), F.ceil(pos)]
    below = F.expr("transform(_counts, (x, i) -> struct(x._range, aggregate(slice(_counts, 1, i), 0L, (a, y) -> a + y.c) AS below, x.c))")
    wanted = (
        group.withColumn("_ranks", F.array(*ranks))
        .withColumn("_at", F.explode(below))
        .select(*part, "n", "mean", "_at._range", "_at.below", F.filter("_ranks", lambda r: (r >= F.col("_at.below")) & (r < F.col("_at.below") + F.col("_at.c"))).alias("_ranks"))
        .filter(F.size("_ranks") > 0)
    )
    upto = Window.partitionBy(*part, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = beside(ranged, wanted, [*part, "_range"]).withColumn("_end", F.col("below") + F.sum("c").over(upto))
    per = held.groupBy(*part).agg(
        F.max("n").alias("n"),
        F.max("mean").alias("mean"),
        *[F.min(F.when(F.col("_end") > r, F.col("value"))).alias(f"v{i}") for i, r in enumerate(ranks)],
    )
    qs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n") - 1).cast("double")
        lo, hi = F.floor(pos), F.ceil(pos)
        at_lo, at_hi = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        qs.append(F.when((hi == lo) | (at_lo == at_hi), at_lo).otherwise((hi - pos) * at_lo + (pos - lo) * at_hi))
    return per.select(*part, "n", F.array(*qs).alias("q"), "mean")


def distribution(
    clean_df: DataFrame,
    metrics: Sequence[tuple[str, str]] = DISTRIBUTION_METRICS,
    probs: Sequence[float] = PERCENTILES,
    approx_accuracy: int | None = None,
    spec: ExperimentSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Percentiles (linear interpolation) and mean per arm and metric, in one pass.

    Exact by default through the distributed selection of ``exact_percentiles``, whatever
    the number of a metric's values. ``approx_accuracy`` switches to ``percentile_approx``
    (small fixed-size sketches).
    """
    n = normal(clean_df, spec)
    names = [_PCT_NAMES.get(round(p, 2), f"p{int(round(p * 100))}") for p in probs]
    if approx_accuracy:
        prob_sql = ", ".join(repr(float(p)) for p in probs)
        aggs = []
        for i, (_, c) in enumerate(metrics):
            q = F.expr(f"percentile_approx(CAST({c} AS DOUBLE), array({prob_sql}), {int(approx_accuracy)})")
            aggs += [q.alias(f"q{i}"), avg_d(c).alias(f"m{i}")]
        wide = n.groupBy("test_group").agg(*aggs)
        stack_args = ", ".join(f"'{label}', q{i}, m{i}" for i, (label, _) in enumerate(metrics))
        long = wide.selectExpr("test_group", f"stack({len(metrics)}, {stack_args}) AS (metric, q, mean)")
    else:
        long = exact_percentiles(n, ["test_group"], metrics, probs)
    return long.select(
        "test_group",
        "metric",
        *[rnd(F.col("q")[i], 2).alias(name) for i, name in enumerate(names)],
        rnd("mean", 2).alias("mean"),
    ).orderBy("metric", "test_group")


def histogram(
    clean_df: DataFrame,
    column: str = "widgets_viewed",
    bins: Sequence[Bin] = WIDGET_BINS,
    bin_name: str = "widget_bin",
    spec: ExperimentSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Sessions per arm and bin, the bin's share of the arm, and its conversion rate."""
    n = normal(clean_df, spec)
    return (
        n.groupBy("test_group", binned(column, bins).alias(bin_name))
        .agg(F.count("*").alias("sessions"), pct("conversion_flag").alias("conversion_rate_pct"))
        .select(
            "test_group",
            bin_name,
            "sessions",
            share_of("sessions", "test_group").alias("pct_of_group"),
            "conversion_rate_pct",
        )
        .orderBy("test_group", bin_name)
    )


def rate_by_level(clean_df: DataFrame, level: str = "widgets_viewed", spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Conversion rate at each value of an engagement count, per arm.

    Equal to the per-row window average followed by DISTINCT, computed as a plain
    grouped average (no full-row shuffle).
    """
    n = normal(clean_df, spec)
    return (
        n.groupBy("test_group", level)
        .agg(pct("conversion_flag").alias("conv_rate_for_widget_level" if level == "widgets_viewed" else "conv_rate_for_level"))
        .orderBy("test_group", level)
    )


def level_counts(clean_df: DataFrame, level: str = "filters_applied", spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Sessions, conversions and conversion rate at each value of ``level``, per arm."""
    n = normal(clean_df, spec)
    return (
        n.groupBy("test_group", level)
        .agg(
            F.count("*").alias("sessions"),
            F.sum("conversion_flag").cast("bigint").alias("conversions"),
            pct("conversion_flag").alias("conversion_rate_pct"),
        )
        .orderBy("test_group", level)
    )


def time_buckets(clean_df: DataFrame, bins: Sequence[Bin] = TIME_BUCKETS, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Dwell-time buckets per arm: sessions, conversion rate, average widgets."""
    n = normal(clean_df, spec)
    return (
        n.groupBy("test_group", binned("time_on_dashboard_clean", bins).alias("time_bucket"))
        .agg(
            F.count("*").alias("sessions"),
            pct("conversion_flag").alias("conversion_rate_pct"),
            rnd(avg_d("widgets_viewed"), 2).alias("avg_widgets"),
        )
        .orderBy("test_group", "time_bucket")
    )
