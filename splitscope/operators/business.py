"""Business impact: ROI projection, segment recommendations, computed findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import chi2_critical_col, chi2_sf, normal_sf, rnd
from ..spec import (
    DEFAULT_ROI,
    DEFAULT_SPEC,
    FINDINGS_BALANCED,
    FINDINGS_READY,
    FINDINGS_TITLE,
    ExperimentSpec,
    RoiAssumptions,
)
from .clean import normal, normal_predicate
from .randomization import rejects, with_expected


def _rates(clean_df: DataFrame, dim: str | None, spec: ExperimentSpec, with_total: bool = True) -> DataFrame:
    """Per ``dim`` value (or overall): sessions and conversions of each arm, plus a rollup row 'All'."""
    n = normal(clean_df, spec)
    is_a = F.col("test_group") == spec.control
    is_b = F.col("test_group") == spec.treatment
    y = F.col("conversion").cast("bigint")
    aggs = [
        F.count_if(is_a & y.isNotNull()).alias("n_a"),
        F.count_if(is_b & y.isNotNull()).alias("n_b"),
        F.coalesce(F.sum(F.when(is_a, y)), F.lit(0)).alias("x_a"),
        F.coalesce(F.sum(F.when(is_b, y)), F.lit(0)).alias("x_b"),
    ]
    if dim is None:
        return n.agg(*aggs).select(F.lit("All").alias("segment"), "*")
    if not with_total:
        return n.groupBy(dim).agg(*aggs).select(F.col(dim).cast("string").alias("segment"), "n_a", "n_b", "x_a", "x_b")
    # per-value rows and the 'All' total in one pass: rollup over the dimension
    rolled = n.rollup(dim).agg(*aggs, F.grouping(dim).alias("is_total"))
    label = F.when(F.col("is_total") == 1, F.lit("All")).otherwise(F.col(dim).cast("string"))
    return rolled.select(label.alias("segment"), "n_a", "n_b", "x_a", "x_b")


def roi(
    clean_df: DataFrame,
    dim: str | None = "cookie_segment",
    assumptions: RoiAssumptions = DEFAULT_ROI,
    spec: ExperimentSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Annual revenue per arm, revenue lift, cost, net benefit, ROI, payback, break-even
    (in sessions, and in days of 365 a year at the assumed traffic).

    Each ``dim`` value gets its share of the monthly sessions and of the cost, by its
    share of Normal sessions (our choice); the 'All' row is the whole site. Payback
    and break-even are NULL where the treatment does not gain.
    """
    a = assumptions
    rates = _rates(clean_df, dim, spec).filter((F.col("n_a") > 0) & (F.col("n_b") > 0))
    share = (F.col("n_a") + F.col("n_b")).cast("double") / F.max(
        F.when(F.col("segment") == "All", F.col("n_a") + F.col("n_b"))
    ).over(Window.partitionBy()).cast("double")
    p_a = F.col("x_a") / F.col("n_a").cast("double")
    p_b = F.col("x_b") / F.col("n_b").cast("double")
    yearly_sessions = F.lit(a.monthly_sessions * a.months) * share
    rev_a = yearly_sessions * p_a * F.lit(a.order_value)
    rev_b = yearly_sessions * p_b * F.lit(a.order_value)
    cost = (F.lit(a.implementation_cost) + F.lit(a.monthly_maintenance * a.months)) * share
    lift = rev_b - rev_a
    net = lift - cost
    per_session_gain = (p_b - p_a) * F.lit(a.order_value)
    daily_sessions = F.lit(a.monthly_sessions * 12 / 365) * share
    return rates.select(
        F.col("segment").alias(dim or "segment"),
        rnd(share * 100, 2).alias("pct_of_sessions"),
        rnd(p_a * 100, 2).alias("rate_a_pct"),
        rnd(p_b * 100, 2).alias("rate_b_pct"),
        rnd(rev_a, 2).alias("annual_revenue_a"),
        rnd(rev_b, 2).alias("annual_revenue_b"),
        rnd(lift, 2).alias("annual_revenue_lift"),
        rnd(cost, 2).alias("total_cost"),
        rnd(net, 2).alias("net_benefit"),
        rnd(net / F.nullif(cost, F.lit(0.0)) * 100, 2).alias("roi_pct"),
        # no payback and no break-even when the treatment does not gain (NULL)
        rnd(F.when(lift > 0, cost / (lift / F.lit(float(a.months)))), 4).alias("payback_months"),
        F.ceil(rnd(F.when(per_session_gain > 0, cost / per_session_gain), 6)).cast("bigint").alias("break_even_sessions"),
        rnd(F.when(per_session_gain > 0, cost / per_session_gain / daily_sessions), 2).alias("break_even_days"),
    ).orderBy(F.col(dim or "segment") == "All", dim or "segment")


def recommend(
    clean_df: DataFrame,
    dim: str = "cookie_segment",
    assumptions: RoiAssumptions = DEFAULT_ROI,
    spec: ExperimentSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Rank ``dim`` values for rollout: Bonferroni-significant positive lift first, by revenue lift.

    Verdicts: ROLL OUT (significant, positive), DO NOT ROLL OUT (significant,
    negative), MONITOR (not significant). One pass: the per-value arm counts feed
    both the test and the revenue projection.
    """
    a = assumptions
    rates = _rates(clean_df, dim, spec, with_total=False).filter((F.col("n_a") > 0) & (F.col("n_b") > 0))
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    p_a, p_b = F.col("x_a") / n_a, F.col("x_b") / n_b
    pooled = (F.col("x_a") + F.col("x_b")) / (n_a + n_b)
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / n_a + F.lit(1.0) / n_b))
    z = (p_b - p_a) / F.nullif(se, F.lit(0.0))
    # one-sided p for improvement, and for harm; Bonferroni over the values tested
    m = F.count("*").over(Window.partitionBy())
    p_up = F.least(F.lit(1.0), normal_sf(z) * m)
    p_down = F.least(F.lit(1.0), normal_sf(-z) * m)
    total = F.sum(n_a + n_b).over(Window.partitionBy())
    lift_rev = F.lit(a.monthly_sessions * a.months * a.order_value) * (n_a + n_b) / total * (p_b - p_a)
    verdict = (
        F.when(p_up < F.lit(spec.alpha), "ROLL OUT")
        .when(p_down < F.lit(spec.alpha), "DO NOT ROLL OUT")
        .otherwise("MONITOR")
    )
    scored = rates.select(
        F.col("segment").alias(dim),
        rnd((p_b - p_a) / F.nullif(p_a, F.lit(0.0)) * 100, 1).alias("relative_lift_pct"),
        rnd(p_up, 6).alias("p_value_bonferroni"),
        rnd(lift_rev, 2).alias("annual_revenue_lift"),
        verdict.alias("recommendation"),
    )
    order = Window.orderBy(
        F.when(F.col("recommendation") == "ROLL OUT", 0).when(F.col("recommendation") == "MONITOR", 1).otherwise(2),
        F.desc("annual_revenue_lift"),
        dim,
    )
    return scored.withColumn("priority", F.row_number().over(order).cast("bigint")).orderBy("priority")


def findings(clean_df: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Status lines computed from the data (the published banner states them as fixed text).

    One pass: cookie segment x arm cells carry all-row counts (balance test) and, for
    Normal rows, the additive sums behind the conversion rates and the
    widgets/filters-to-conversion correlations.
    """
    is_normal = normal_predicate("page_load_time_raw", "time_on_dashboard_raw", spec)
    y = F.col("conversion").cast("double")
    w = F.col("widgets_viewed").cast("double")
    f = F.col("filters_applied").cast("double")

    def moments(name, x):
        """Sums behind a correlation, over the Normal rows where both sides are known."""
        both = is_normal & x.isNotNull() & y.isNotNull()
        sums = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
        return [F.coalesce(F.sum(F.when(both, e)), F.lit(0.0)).alias(f"{name}_{k}") for k, e in sums.items()]

    pairs = [*moments("w", w), *moments("f", f)]
    names = [f"{name}_{k}" for name in "wf" for k in ("n", "x", "y", "xx", "yy", "xy")]
    cells = clean_df.groupBy("cookie_segment", "group_id").agg(
        F.count("*").alias("obs"),
        F.count_if(is_normal & y.isNotNull()).alias("nn"),
        F.sum(F.when(is_normal, y)).alias("sy"),
        *pairs,
    )
    # chi-square components on the cells, then one global aggregate over the same
    # chain (a second consumer of ``cells`` would re-read the table)
    comp = with_expected(cells.withColumnRenamed("obs", "observed"), "cookie_segment", "group_id").withColumn(
        "component",
        F.pow(F.col("observed") - F.col("expected"), 2) / F.nullif(F.col("expected"), F.lit(0.0)),
    )
    tot = comp.agg(
        *[F.sum(c).alias(c) for c in names],
        F.sum(F.when(F.col("group_id") == spec.control, F.col("sy"))).alias("conv_a"),
        F.sum(F.when(F.col("group_id") == spec.control, F.col("nn"))).alias("n_a"),
        F.sum(F.when(F.col("group_id") == spec.treatment, F.col("sy"))).alias("conv_b"),
        F.sum(F.when(F.col("group_id") == spec.treatment, F.col("nn"))).alias("n_b"),
        F.sum("component").alias("stat"),
        ((F.count_distinct("cookie_segment") - 1) * (F.count_distinct("group_id") - 1)).alias("dof"),
    ).withColumns({"critical_value": chi2_critical_col("dof", spec.alpha), "p_value": chi2_sf("stat", "dof")})

    def corr(name):
        n, sx, sy, sxx, syy, sxy = (F.col(f"{name}_{k}") for k in ("n", "x", "y", "xx", "yy", "xy"))
        return (n * sxy - sx * sy) / F.nullif(F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), F.lit(0.0))

    rate_a = F.col("conv_a") / F.nullif(F.col("n_a").cast("double"), F.lit(0.0)) * 100
    rate_b = F.col("conv_b") / F.nullif(F.col("n_b").cast("double"), F.lit(0.0)) * 100
    r_w, r_f = corr("w"), corr("f")
    fmt = lambda c: F.format_number(rnd(c, 2), 2)
    line1 = F.concat(
        F.lit(f"1. Group {spec.treatment} shows "),
        F.when(rate_b > rate_a, "higher").when(rate_b < rate_a, "lower").otherwise("equal"),
        F.lit(" conversion rate ("),
        fmt(rate_b),
        F.lit("% vs "),
        fmt(rate_a),
        F.lit("%)"),
    )
    line2 = F.concat(
        F.lit("2. Engagement (widgets, filters) "),
        F.when((r_w > 0) & (r_f > 0), "positively correlates")
        .when((r_w < 0) & (r_f < 0), "negatively correlates")
        .otherwise("shows mixed correlation"),
        F.lit(" with conversion"),
    )
    unbalanced = rejects()
    line3 = F.when(unbalanced, "3. Test groups are NOT balanced across segments").otherwise(FINDINGS_BALANCED)
    line4 = F.when(unbalanced, "4. Fix randomization before significance testing").otherwise(FINDINGS_READY)
    lines = F.array(F.lit(FINDINGS_TITLE), line1, line2, line3, line4)
    return (
        tot.select(F.posexplode(lines).alias("pos", "status"))
        .orderBy("pos")
        .select("status")
    )
