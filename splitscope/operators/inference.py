"""Significance tests on sufficient statistics.

Every test first reduces the sessions to a handful of additive numbers per arm
(or per stratum x arm): counts, sums, sums of squares. That reduction is the only
pass over the data and is map-side combined; the statistics are then column
expressions on the few result rows, so nothing per-row leaves the executors.

Formulas the analysis names without spelling out are our choices, stated per
function: unpooled Wald interval, Welch large-sample z for means, Bonferroni
over the strata tested, the standard two-proportion power formula.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import avg_d, chi2_critical_col, chi2_sf, normal_cdf, normal_quantile, normal_sf, rnd, two_sided_p
from ..spec import DEFAULT_SPEC, ExperimentSpec
from .clean import ANOMALY, QUALITY_NORMAL, normal, normal_predicate
from .randomization import rejects


def _arm_counts(df: DataFrame, outcome: str, keys: Sequence[str], spec: ExperimentSpec) -> DataFrame:
    """Per key: sessions with a known outcome and successes of each arm, pivoted by conditional aggregation."""
    is_a = F.col("test_group") == spec.control
    is_b = F.col("test_group") == spec.treatment
    y = F.col(outcome).cast("bigint")
    return df.groupBy(*keys).agg(
        F.count_if(is_a & y.isNotNull()).alias("n_a"),
        F.count_if(is_b & y.isNotNull()).alias("n_b"),
        F.coalesce(F.sum(F.when(is_a, y)), F.lit(0)).alias("x_a"),
        F.coalesce(F.sum(F.when(is_b, y)), F.lit(0)).alias("x_b"),
    )


def _with_proportions(counts: DataFrame, alpha: float) -> DataFrame:
    """Adds to n_a, n_b, x_a, x_b: rates, pooled z (H1: treatment > control), its tails and the
    unpooled Wald interval.

    In steps, each on columns of the last: z is long, and the tail names it many times,
    so as one expression the plan would repeat it in every place.
    """
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    p_a, p_b, pooled = F.col("p_a"), F.col("p_b"), F.col("pooled")
    one = F.lit(1.0)
    z_ci = F.lit(normal_quantile(1 - alpha / 2))
    return (
        counts.withColumns({"p_a": F.col("x_a") / n_a, "p_b": F.col("x_b") / n_b, "pooled": (F.col("x_a") + F.col("x_b")) / (n_a + n_b)})
        .withColumns(
            {
                "se_pooled": F.sqrt(pooled * (one - pooled) * (one / n_a + one / n_b)),
                "se_wald": F.sqrt(p_a * (one - p_a) / n_a + p_b * (one - p_b) / n_b),
            }
        )
        .withColumns(
            {
                "z": (p_b - p_a) / F.nullif(F.col("se_pooled"), F.lit(0.0)),
                "ci_low": (p_b - p_a) - z_ci * F.col("se_wald"),
                "ci_high": (p_b - p_a) + z_ci * F.col("se_wald"),
            }
        )
        .withColumns({"p_one": normal_sf("z"), "p_two": two_sided_p("z")})
    )


def ztest(clean_df: DataFrame, outcome: str = "conversion", spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Pooled two-proportion z-test of treatment > control on a 0/1 outcome, with the
    (1 - alpha) unpooled Wald interval of the rate difference. One row."""
    n = normal(clean_df, spec)
    z_crit = normal_quantile(1 - spec.alpha)
    counts = _arm_counts(n, outcome, [], spec)
    return _with_proportions(counts.filter((F.col("n_a") > 0) & (F.col("n_b") > 0)), spec.alpha).select(
        F.lit(outcome).alias("metric"),
        "n_a",
        "n_b",
        F.col("x_a").alias("successes_a"),
        F.col("x_b").alias("successes_b"),
        rnd(F.col("p_a") * 100, 4).alias("rate_a_pct"),
        rnd(F.col("p_b") * 100, 4).alias("rate_b_pct"),
        rnd((F.col("p_b") - F.col("p_a")) * 100, 4).alias("diff_pp"),
        rnd(F.col("z"), 4).alias("z_statistic"),
        F.lit(round(z_crit, 4)).alias("z_critical"),
        rnd(F.col("p_one"), 6).alias("p_value"),
        rnd(F.col("p_two"), 6).alias("p_value_two_sided"),
        rnd(F.col("ci_low") * 100, 4).alias("ci_low_pp"),
        rnd(F.col("ci_high") * 100, 4).alias("ci_high_pp"),
        F.when(F.col("z") > F.lit(z_crit), "REJECT NULL - treatment improves the rate")
        .otherwise("ACCEPT NULL - no significant improvement")
        .alias("conclusion"),
    )


def chi2_outcome(clean_df: DataFrame, outcome: str = "conversion", spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Chi-square test of independence of arm and a 0/1 outcome (2 x 2). One row.

    Closed form from the four counts, so an empty cell counts like any other and the
    statistic is the square of the pooled z. NULL outcomes count nowhere; where an arm or
    an outcome is missing the statistic is NULL.
    """
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    hits = F.col("x_a") + F.col("x_b")
    misses = n_a + n_b - hits
    cross = F.col("x_b") * (n_a - F.col("x_a")) - F.col("x_a") * (n_b - F.col("x_b"))
    stat = (n_a + n_b) * cross * cross / F.nullif(n_a * n_b * hits * misses, F.lit(0.0))
    tested = (
        _arm_counts(normal(clean_df, spec), outcome, [], spec)
        .select(stat.alias("stat"), F.lit(1).cast("bigint").alias("dof"))
        .withColumns({"critical_value": chi2_critical_col("dof", spec.alpha), "p_value": chi2_sf("stat", "dof")})
    )
    return tested.select(
        F.lit(outcome).alias("metric"),
        rnd("stat", 4).alias("chi_square_statistic"),
        F.col("dof").alias("degrees_of_freedom"),
        F.col("critical_value"),
        rnd("p_value", 6).alias("p_value"),
        F.when(rejects(), "SIGNIFICANT - arm and outcome are associated")
        .otherwise("NOT SIGNIFICANT - no association")
        .alias("conclusion"),
    )


def stratified_test(
    clean_df: DataFrame, dim: str = "cookie_segment", outcome: str = "conversion", spec: ExperimentSpec = DEFAULT_SPEC
) -> DataFrame:
    """z-test per stratum with Bonferroni correction over the strata tested.

    Strata seen in only one arm are not tested (and do not count toward m).
    """
    n = normal(clean_df, spec)
    counts = _arm_counts(n, outcome, [dim], spec).filter((F.col("n_a") > 0) & (F.col("n_b") > 0))
    m = F.count("*").over(Window.partitionBy())  # strata tested; window over <= strata rows
    tested = _with_proportions(counts, spec.alpha).withColumn("p_adj", F.least(F.lit(1.0), F.col("p_one") * m))
    p_adj = F.col("p_adj")
    return tested.select(
        dim,
        "n_a",
        "n_b",
        rnd(F.col("p_a") * 100, 2).alias("rate_a_pct"),
        rnd(F.col("p_b") * 100, 2).alias("rate_b_pct"),
        rnd((F.col("p_b") - F.col("p_a")) / F.nullif(F.col("p_a"), F.lit(0.0)) * 100, 1).alias("relative_lift_pct"),
        rnd(F.col("z"), 4).alias("z_statistic"),
        rnd(F.col("p_one"), 6).alias("p_value"),
        rnd(p_adj, 6).alias("p_value_bonferroni"),
        F.when(p_adj < F.lit(spec.alpha), "YES").otherwise("NO").alias("significant"),
    ).orderBy(dim)


def simpson_check(
    clean_df: DataFrame, dim: str = "cookie_segment", outcome: str = "conversion", spec: ExperimentSpec = DEFAULT_SPEC
) -> DataFrame:
    """Does the overall direction of the effect hold within every stratum?

    Our reading of "no Simpson's paradox": the paradox is present when every stratum
    shows a difference of the opposite sign to the pooled difference. The pooled
    counts are the sums of the stratum counts (one pass). One row (none without strata).
    """
    n = normal(clean_df, spec)
    strata = _arm_counts(n, outcome, [dim], spec).filter((F.col("n_a") > 0) & (F.col("n_b") > 0))
    diff = F.col("x_b") / F.col("n_b").cast("double") - F.col("x_a") / F.col("n_a").cast("double")
    # pooled counts over the aggregated strata rows (one small window, no second pass)
    allw = Window.partitionBy()
    pooled_diff = F.sum("x_b").over(allw) / F.sum("n_b").over(allw).cast("double") - F.sum("x_a").over(allw) / F.sum(
        "n_a"
    ).over(allw).cast("double")
    per = strata.select(F.signum(diff).alias("sign"), pooled_diff.alias("pooled_diff")).withColumn(
        "overall_sign", F.signum("pooled_diff")
    )
    summary = per.groupBy("pooled_diff", "overall_sign").agg(
        F.count("*").alias("strata"),
        F.count_if(F.col("sign") == F.col("overall_sign")).alias("same"),
        F.count_if(F.col("sign") == -F.col("overall_sign")).alias("opposite"),
    ).withColumn("overall_diff_pp", rnd(F.col("pooled_diff") * 100, 4))
    return summary.select(
        F.lit(dim).alias("dimension"),
        "overall_diff_pp",
        F.col("strata").cast("bigint").alias("strata"),
        F.col("same").cast("bigint").alias("strata_same_direction"),
        F.col("opposite").cast("bigint").alias("strata_opposite_direction"),
        F.when(
            (F.col("overall_sign") != 0) & (F.col("opposite") == F.col("strata")),
            "YES - every stratum reverses the pooled effect",
        )
        .otherwise("NO")
        .alias("simpson_paradox"),
    )


# Metrics of the comparison table, (label, clean column, kind) in table order.
COMPARISON_METRICS = (
    ("Conversion Rate", "conversion", "proportion"),
    ("Bounce Rate", "bounce", "proportion"),
    ("Widgets Viewed", "widgets_viewed", "mean"),
    ("Filters Applied", "filters_applied", "mean"),
    ("Time on Dashboard", "time_on_dashboard_clean", "mean"),
    ("Page Load Time", "page_load_time_clean", "mean"),
)


def metric_comparison(
    clean_df: DataFrame, metrics: Sequence[tuple[str, str, str]] = COMPARISON_METRICS, spec: ExperimentSpec = DEFAULT_SPEC
) -> DataFrame:
    """All-metric table: arm means, absolute and relative lift and a two-sided p-value per metric.

    The absolute lift of a rate is in percentage points.

    Proportions use the pooled two-proportion z; means use Welch's statistic with the
    large-sample normal reference (our choice). One aggregation per arm, pivoted to
    one wide row, then one row per metric via ``stack``.
    """
    n = normal(clean_df, spec)
    aggs = [F.count("*").alias("n")]
    for i, (_, c, _) in enumerate(metrics):
        aggs += [avg_d(c).alias(f"m{i}"), F.var_samp(F.col(c).cast("double")).alias(f"v{i}")]
    per_arm = n.groupBy("test_group").agg(*aggs)
    wide_cols = []
    for side, label in (("a", spec.control), ("b", spec.treatment)):
        pick = F.col("test_group") == label
        wide_cols.append(F.max(F.when(pick, F.col("n"))).alias(f"n_{side}"))
        for i in range(len(metrics)):
            wide_cols.append(F.max(F.when(pick, F.col(f"m{i}"))).alias(f"m{i}_{side}"))
            wide_cols.append(F.max(F.when(pick, F.col(f"v{i}"))).alias(f"v{i}_{side}"))
    wide = per_arm.agg(*wide_cols).filter(F.col("n_a").isNotNull() & F.col("n_b").isNotNull())
    stack_args = ", ".join(
        f"'{label}', '{kind}', m{i}_a, m{i}_b, v{i}_a, v{i}_b" for i, (label, _, kind) in enumerate(metrics)
    )
    long = wide.selectExpr("n_a", "n_b", f"stack({len(metrics)}, {stack_args}) AS (metric, kind, ma, mb, va, vb)")
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    pooled = (F.col("ma") * n_a + F.col("mb") * n_b) / (n_a + n_b)
    se_prop = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / n_a + F.lit(1.0) / n_b))
    se_welch = F.sqrt(F.col("va") / n_a + F.col("vb") / n_b)
    is_rate = F.col("kind") == "proportion"
    se = F.when(is_rate, se_prop).otherwise(se_welch)
    scale = F.when(is_rate, F.lit(100.0)).otherwise(F.lit(1.0))
    # in steps: the tail of a long expression would repeat it many times
    tested = (
        long.withColumns({"scale": scale, "se": se})
        .withColumn("stat", (F.col("mb") - F.col("ma")) / F.nullif(F.col("se"), F.lit(0.0)))
        .withColumn("p", two_sided_p("stat"))
    )
    return tested.select(
        "metric",
        F.when(is_rate, "two-proportion z").otherwise("Welch z").alias("test"),
        rnd(F.col("ma") * F.col("scale"), 2).alias("group_a_value"),
        rnd(F.col("mb") * F.col("scale"), 2).alias("group_b_value"),
        rnd((F.col("mb") - F.col("ma")) * F.col("scale"), 2).alias("absolute_lift"),
        rnd((F.col("mb") - F.col("ma")) / F.nullif(F.col("ma"), F.lit(0.0)) * 100, 1).alias("relative_lift_pct"),
        rnd("stat", 4).alias("statistic"),
        rnd("p", 4).alias("p_value"),
    )


# Engagement features correlated with conversion.
CORRELATION_FEATURES = ("widgets_viewed", "filters_applied", "time_on_dashboard_clean")


def correlations(
    clean_df: DataFrame,
    features: Sequence[str] = CORRELATION_FEATURES,
    target: str = "conversion",
    spec: ExperimentSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Pearson correlation and least-squares slope of each feature with the target, per arm
    and over both arms (``test_group = 'All'``). One pass: ``rollup`` over the arm."""
    n = normal(clean_df, spec)
    aggs = []
    for i, f in enumerate(features):
        # only rows where both sides are known count, on both sides
        x = F.when(F.col(target).isNotNull(), F.col(f).cast("double"))
        y = F.when(F.col(f).isNotNull(), F.col(target).cast("double"))
        # Pearson r from sample moments; NULL (not an error) when either side is constant,
        # e.g. an arm without conversions (``corr`` divides by zero there under ANSI mode)
        r = F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))
        aggs += [r.alias(f"r{i}"), F.regr_slope(y, x).alias(f"b{i}")]
    wide = n.rollup("test_group").agg(F.count("*").alias("n"), F.grouping("test_group").alias("is_total"), *aggs)
    stack_args = ", ".join(f"'{f}', r{i}, b{i}" for i, f in enumerate(features))
    return (
        wide.select(
            F.when(F.col("is_total") == 1, F.lit("All")).otherwise(F.col("test_group")).alias("test_group"),
            "n",
            F.expr(f"stack({len(features)}, {stack_args}) AS (feature, r, b)"),
        )
        .select(
            "test_group",
            "feature",
            "n",
            rnd("r", 4).alias("correlation"),
            rnd("b", 6).alias("slope"),
        )
        .orderBy("test_group", "feature")
    )


def _whole(x: Column) -> Column:
    """The next whole number as BIGINT; NULL beyond 2**53, where a double holds no single units."""
    return F.when(x < F.lit(float(2**53)), F.ceil(rnd(x, 6)).cast("bigint")).otherwise(F.lit(None).cast("bigint"))


def power_analysis(
    clean_df: DataFrame,
    dim: str | None = "cookie_segment",
    target_power: float = 0.8,
    outcome: str = "conversion",
    spec: ExperimentSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Achieved power of the one-sided test at the observed rates and sample sizes, and
    the sessions per arm needed to reach ``target_power`` (standard two-proportion
    formula, our choice), per ``dim`` value or overall when ``dim`` is None."""
    n = normal(clean_df, spec)
    keys = [dim] if dim else []
    counts = _arm_counts(n, outcome, keys, spec).filter((F.col("n_a") > 0) & (F.col("n_b") > 0))
    z_a = normal_quantile(1 - spec.alpha)
    z_b = normal_quantile(target_power)
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    p_a, p_b = F.col("x_a") / n_a, F.col("x_b") / n_b
    delta = F.abs(p_b - p_a)
    pooled = (F.col("x_a") + F.col("x_b")) / (n_a + n_b)
    se0 = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / n_a + F.lit(1.0) / n_b))
    se1 = F.sqrt(p_a * (F.lit(1.0) - p_a) / n_a + p_b * (F.lit(1.0) - p_b) / n_b)
    achieved = normal_cdf((delta - F.lit(z_a) * se0) / F.nullif(se1, F.lit(0.0)))
    p_bar = (p_a + p_b) / 2
    need = F.pow(
        F.lit(z_a) * F.sqrt(F.lit(2.0) * p_bar * (F.lit(1.0) - p_bar))
        + F.lit(z_b) * F.sqrt(p_a * (F.lit(1.0) - p_a) + p_b * (F.lit(1.0) - p_b)),
        2,
    ) / F.nullif(F.pow(p_b - p_a, 2), F.lit(0.0))
    label = F.col(dim) if dim else F.lit("All")
    out = counts.select(
        label.alias(dim or "segment"),
        "n_a",
        "n_b",
        rnd(p_a * 100, 2).alias("rate_a_pct"),
        rnd(p_b * 100, 2).alias("rate_b_pct"),
        rnd(achieved, 4).alias("achieved_power"),
        _whole(need).alias("required_n_per_arm"),
        F.when(achieved >= F.lit(target_power), "YES").otherwise("NO").alias("adequately_powered"),
    )
    return out.orderBy(dim) if dim else out


def sensitivity(clean_df: DataFrame, outcome: str = "conversion", spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Conversion lift under alternative row selections (our choice of scenarios):

    * ``all_sessions``: every row, quality ignored;
    * ``normal_only``: the analysis population;
    * ``excluding_anomalies``: Normal and (clamped) Outlier rows;
    * ``first_session_per_user``: Normal rows, each user's first session only;
    * ``user_clustered``: ``normal_only`` with a standard error that takes the user, not the
      session, as the unit that varies: the delta method on the users' sums (sessions n,
      outcomes y), ``K/(K-1) sum((y - r n)^2) / (sum n)^2`` per arm of K users and rate r.

    A per-user aggregation holds the conditional counts of all scenarios and the time of the
    user's first Normal session, all in fixed-width buffers, so it is hashed and never sorts
    sessions. Only the sessions at that time are looked at again, to settle ties by id. Global
    aggregations sum both, and ``stack`` gives one row per scenario.
    """
    q = F.col("data_quality")
    is_normal = normal_predicate("page_load_time_raw", "time_on_dashboard_raw", spec)
    y = F.col(outcome).cast("bigint")
    arm = F.col("group_id")
    # row-level scenarios, as conditional counts per arm
    row_scenarios = {
        "all_sessions": F.lit(True),
        "normal_only": q == QUALITY_NORMAL,
        "excluding_anomalies": q != ANOMALY,
    }
    aggs = []
    for name, cond in row_scenarios.items():
        for side, label in (("a", spec.control), ("b", spec.treatment)):
            hit = cond & (arm == label) & y.isNotNull()
            aggs += [F.count_if(hit).alias(f"{name}__n_{side}"), F.sum(F.when(hit, y)).alias(f"{name}__x_{side}")]
    aggs.append(F.min(F.when(is_normal, F.col("session_timestamp"))).alias("first_ts"))
    # a user without a time among the Normal sessions: those with unknown time come first
    aggs.append(F.count_if(is_normal & F.col("session_timestamp").isNull()).alias("untimed"))
    # one pass: per-user partial sums (a hot user is pre-aggregated map-side), then totals
    per_user = clean_df.groupBy("user_id").agg(*aggs)
    totals = []
    for name in row_scenarios:
        for side in ("a", "b"):
            totals += [
                F.sum(f"{name}__n_{side}").alias(f"{name}__n_{side}"),
                F.coalesce(F.sum(f"{name}__x_{side}"), F.lit(0)).alias(f"{name}__x_{side}"),
            ]
    # moments of the users' sums, for the clustered error
    for side in ("a", "b"):
        sessions_, hits = F.col(f"normal_only__n_{side}").cast("double"), F.coalesce(f"normal_only__x_{side}", F.lit(0)).cast("double")
        totals += [
            F.count_if(sessions_ > 0).cast("double").alias(f"users_{side}"),
            F.sum(sessions_ * sessions_).alias(f"nn_{side}"),
            F.sum(sessions_ * hits).alias(f"ny_{side}"),
            F.sum(hits * hits).alias(f"yy_{side}"),
        ]
    starts = per_user.filter("first_ts IS NOT NULL OR untimed > 0").select(
        F.col("user_id").alias("key_user"), F.when(F.col("untimed") == 0, F.col("first_ts")).alias("key_ts")
    )
    visits = clean_df.filter(is_normal).select("user_id", "session_timestamp", "session_id", arm.alias("arm"), y.alias("y"))
    at_start = visits.join(starts, F.col("user_id").eqNullSafe(F.col("key_user")) & F.col("session_timestamp").eqNullSafe(F.col("key_ts")))
    firsts = at_start.groupBy("user_id").agg(F.min_by(F.struct("arm", "y"), "session_id").alias("first"))
    first_totals = []
    for side, label in (("a", spec.control), ("b", spec.treatment)):
        first_hit = (F.col("first.arm") == label) & F.col("first.y").isNotNull()
        first_totals += [
            F.count_if(first_hit).alias(f"first_session_per_user__n_{side}"),
            F.coalesce(F.sum(F.when(first_hit, F.col("first.y"))), F.lit(0)).alias(f"first_session_per_user__x_{side}"),
        ]
    # one row beside one row
    one = F.lit(1).alias("_one")
    wide = per_user.agg(*totals).withColumn("_one", one).join(firsts.agg(*first_totals).withColumn("_one", one), "_one")
    for side in ("a", "b"):
        k, total = F.col(f"users_{side}"), F.nullif(F.col(f"normal_only__n_{side}").cast("double"), F.lit(0.0))
        rate = F.col(f"normal_only__x_{side}") / total
        spread = F.col(f"yy_{side}") - 2 * rate * F.col(f"ny_{side}") + rate * rate * F.col(f"nn_{side}")
        wide = wide.withColumn(f"var_{side}", k / F.nullif(k - 1, F.lit(0.0)) * spread / (total * total))
    names = [*row_scenarios, "first_session_per_user"]
    stacked = [f"'{nm}', {nm}__n_a, {nm}__n_b, {nm}__x_a, {nm}__x_b, CAST(NULL AS DOUBLE)" for nm in names]
    stacked.append("'user_clustered', normal_only__n_a, normal_only__n_b, normal_only__x_a, normal_only__x_b, sqrt(var_a + var_b)")
    counts = wide.selectExpr(f"stack({len(stacked)}, {', '.join(stacked)}) AS (scenario, n_a, n_b, x_a, x_b, se_clustered)").filter(
        (F.col("n_a") > 0) & (F.col("n_b") > 0)
    )
    by_user = F.col("scenario") == "user_clustered"
    tested = _with_proportions(counts, spec.alpha)
    tested = tested.withColumn("z", F.when(by_user, (F.col("p_b") - F.col("p_a")) / F.nullif(F.col("se_clustered"), F.lit(0.0))).otherwise(F.col("z")))
    return tested.withColumn("p_one", normal_sf("z")).select(
        "scenario",
        "n_a",
        "n_b",
        rnd(F.col("p_a") * 100, 2).alias("rate_a_pct"),
        rnd(F.col("p_b") * 100, 2).alias("rate_b_pct"),
        rnd((F.col("p_b") - F.col("p_a")) * 100, 2).alias("absolute_lift_pp"),
        rnd((F.col("p_b") - F.col("p_a")) / F.nullif(F.col("p_a"), F.lit(0.0)) * 100, 1).alias("relative_lift_pct"),
        rnd(F.col("z"), 4).alias("z_statistic"),
        rnd(F.col("p_one"), 6).alias("p_value"),
    ).orderBy("scenario")
