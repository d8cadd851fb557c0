"""Preparation summary, quality breakdown, per-arm KPI summary and KPI lift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import avg_d, flag, pct, rnd, stddev0
from ..spec import DEFAULT_SPEC, PREP_STATUS, ExperimentSpec
from .clean import normal
from .common import share_of
from .distribution import exact_percentiles


def prep_summary(clean_df: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Status row over Normal sessions: sessions, users, sessions/user, first, last, days covered."""
    n = normal(clean_df, spec)
    ts = F.col("session_timestamp")
    # one distinct aggregate next to count/min/max: Spark groups by user first, and
    # that stage carries only three small buffers per user
    totals = n.agg(
        F.count("*").alias("total_sessions"),
        F.count_distinct("user_id").alias("unique_users"),
        F.min(ts).alias("first_session"),
        F.max(ts).alias("last_session"),
    )
    secs = F.expr(
        "timestampdiff(SECOND, date_trunc('second', first_session), date_trunc('second', last_session))"
    )
    return totals.select(
        F.lit(PREP_STATUS).alias("status"),
        "total_sessions",
        "unique_users",
        rnd(F.col("total_sessions") / F.nullif(F.col("unique_users"), F.lit(0)), 2).alias("avg_sessions_per_user"),
        "first_session",
        "last_session",
        rnd(secs / F.lit(86400.0), 0).alias("days_of_data"),
    )


def quality_breakdown(clean_df: DataFrame) -> DataFrame:
    """Count and share of each ``data_quality`` value, most frequent first."""
    return (
        clean_df.groupBy("data_quality")
        .agg(F.count("*").alias("record_count"))
        .select("data_quality", "record_count", share_of("record_count").alias("percentage"))
        .orderBy(F.desc("record_count"))
    )


def group_summary(
    clean_df: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC, approx_users: float | None = None
) -> DataFrame:
    """Per-arm KPI summary over Normal sessions (18 columns).

    Two passes. The KPIs and the exact distinct-user count share one aggregation:
    Spark plans a single distinct aggregate by grouping on (arm, user) first, with
    only the small count/sum buffers of the other KPIs attached, so a hot user is
    pre-aggregated per task and no second read of the table is needed.
    ``approx_users=rsd`` counts users with HyperLogLog++ at that relative standard
    deviation instead (no shuffle by user). The medians come from the distributed
    value histogram of ``distribution.exact_percentiles`` (the second pass).
    """
    n = normal(clean_df, spec)
    if approx_users:
        users = F.approx_count_distinct("user_id", approx_users)
    else:
        users = F.count_distinct("user_id")
    metrics = n.groupBy("test_group").agg(
        F.count("*").alias("total_sessions"),
        users.alias("unique_users"),
        F.sum("conversion").cast("bigint").alias("conversions"),
        pct("conversion").alias("conversion_rate_pct"),
        rnd(stddev0("conversion"), 4).alias("conversion_stddev"),
        F.sum("bounce").cast("bigint").alias("bounces"),
        pct("bounce").alias("bounce_rate_pct"),
        pct(flag(F.col("bounce") == 0)).alias("engagement_rate_pct"),
        rnd(avg_d("widgets_viewed"), 2).alias("avg_widgets_viewed"),
        rnd(avg_d("filters_applied"), 2).alias("avg_filters_applied"),
        rnd(avg_d("time_on_dashboard_clean"), 2).alias("avg_time_on_dashboard"),
        rnd(avg_d("page_load_time_clean"), 2).alias("avg_page_load_time"),
        pct("widget_engaged").alias("pct_sessions_with_widgets"),
        pct("filter_engaged").alias("pct_sessions_with_filters"),
    )
    # medians from the distributed value histogram (see distribution.exact_percentiles)
    med = exact_percentiles(
        n, ["test_group"], [("time", "time_on_dashboard_clean"), ("load", "page_load_time_clean")], [0.5]
    ).groupBy("test_group").agg(
        rnd(F.max(F.when(F.col("metric") == "time", F.col("q")[0])), 2).alias("median_time_on_dashboard"),
        rnd(F.max(F.when(F.col("metric") == "load", F.col("q")[0])), 2).alias("median_page_load_time"),
    )
    # one row per arm on both sides; AQE turns this into a broadcast join from the measured sizes
    return (
        metrics.join(med, "test_group", "left")
        .select(
            "test_group",
            "total_sessions",
            "unique_users",
            rnd(F.col("total_sessions") / F.col("unique_users"), 2).alias("sessions_per_user"),
            "conversions",
            "conversion_rate_pct",
            "conversion_stddev",
            "bounces",
            "bounce_rate_pct",
            "engagement_rate_pct",
            "avg_widgets_viewed",
            "avg_filters_applied",
            "avg_time_on_dashboard",
            "median_time_on_dashboard",
            "avg_page_load_time",
            "median_page_load_time",
            "pct_sessions_with_widgets",
            "pct_sessions_with_filters",
        )
        .orderBy("test_group")
    )


# KPI rows of the lift report, in report order: (label, summary column).
LIFT_KPIS = (
    ("Conversion Rate", "conversion_rate_pct"),
    ("Bounce Rate", "bounce_rate_pct"),
    ("Avg Widgets Viewed", "avg_widgets_viewed"),
    ("Avg Filters Applied", "avg_filters_applied"),
    ("Avg Time on Dashboard", "avg_time_on_dashboard"),
    ("Avg Page Load Time", "avg_page_load_time"),
)


def kpi_lift(clean_df: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Absolute and relative difference treatment vs control for six KPIs, one row each.

    One scan: per-arm rounded KPIs (as in the summary), pivoted by conditional
    aggregation over the two arm rows, then unpivoted with ``stack``. The lift is
    computed from the already rounded KPI values, as the summary report shows them.
    No row when an arm is missing.
    """
    n = normal(clean_df, spec)
    per_arm = n.groupBy("test_group").agg(
        pct("conversion").alias("conversion_rate_pct"),
        pct("bounce").alias("bounce_rate_pct"),
        rnd(avg_d("widgets_viewed"), 2).alias("avg_widgets_viewed"),
        rnd(avg_d("filters_applied"), 2).alias("avg_filters_applied"),
        rnd(avg_d("time_on_dashboard_clean"), 2).alias("avg_time_on_dashboard"),
        rnd(avg_d("page_load_time_clean"), 2).alias("avg_page_load_time"),
    )
    wide_cols = []
    for _, c in LIFT_KPIS:
        wide_cols.append(F.max(F.when(F.col("test_group") == spec.control, F.col(c))).alias(f"a_{c}"))
        wide_cols.append(F.max(F.when(F.col("test_group") == spec.treatment, F.col(c))).alias(f"b_{c}"))
    has_a = F.max(F.when(F.col("test_group") == spec.control, 1)).alias("has_a")
    has_b = F.max(F.when(F.col("test_group") == spec.treatment, 1)).alias("has_b")
    wide = per_arm.agg(*wide_cols, has_a, has_b).filter("has_a = 1 AND has_b = 1")
    stack_args = ", ".join(f"'{label}', a_{c}, b_{c}" for label, c in LIFT_KPIS)
    long = wide.selectExpr(f"stack({len(LIFT_KPIS)}, {stack_args}) AS (metric, group_a_value, group_b_value)")
    diff = F.col("group_b_value") - F.col("group_a_value")
    return long.select(
        "metric",
        "group_a_value",
        "group_b_value",
        rnd(diff, 2).alias("absolute_diff"),
        rnd(diff / F.nullif(F.col("group_a_value"), F.lit(0.0)) * 100, 2).alias("relative_lift_pct"),
    )
