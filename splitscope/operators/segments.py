"""Segment profiles (dimension x arm) and conversion lift per segment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import avg_d, pct, rnd
from ..spec import DEFAULT_SPEC, ExperimentSpec
from .clean import normal


# Named profile measures, built on demand.
MEASURES: dict[str, Callable[[], Column]] = {
    "sessions": lambda: F.count("*"),
    "conversions": lambda: F.sum("conversion_flag").cast("bigint"),
    "conversion_rate_pct": lambda: pct("conversion_flag"),
    "bounce_rate_pct": lambda: pct("bounce_flag"),
    "avg_widgets": lambda: rnd(avg_d("widgets_viewed"), 2),
    "avg_filters": lambda: rnd(avg_d("filters_applied"), 2),
    "avg_time_sec": lambda: rnd(avg_d("time_on_dashboard_clean"), 1),
    "avg_load_time": lambda: rnd(avg_d("page_load_time_clean"), 2),
}


# Measure lists of the three published profiles, in column order.
SEGMENT_MEASURES = (
    "sessions", "conversions", "conversion_rate_pct", "bounce_rate_pct", "avg_widgets", "avg_filters", "avg_time_sec",
)
DEVICE_MEASURES = ("sessions", "conversion_rate_pct", "avg_load_time", "avg_time_sec", "avg_widgets")
COUNTRY_MEASURES = ("sessions", "conversion_rate_pct", "bounce_rate_pct")


def profile(
    clean_df: DataFrame,
    dim: str,
    measures: Sequence[str] = SEGMENT_MEASURES,
    order_by_sessions: bool = False,
    spec: ExperimentSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Named measures per ``dim x arm`` over Normal sessions (one grouped aggregation)."""
    n = normal(clean_df, spec)
    out = n.groupBy(dim, "test_group").agg(*[MEASURES[m]().alias(m) for m in measures])
    if order_by_sessions:
        return out.orderBy(F.desc("sessions"))
    return out.orderBy(dim, "test_group")


def segment_profile(clean_df: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    return profile(clean_df, "cookie_segment", SEGMENT_MEASURES, spec=spec)


def device_profile(clean_df: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    return profile(clean_df, "device_type", DEVICE_MEASURES, spec=spec)


def country_profile(clean_df: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    return profile(clean_df, "country", COUNTRY_MEASURES, order_by_sessions=True, spec=spec)


def segment_lift(
    clean_df: DataFrame,
    dim: str = "cookie_segment",
    with_share: bool = False,
    spec: ExperimentSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Conversion rate of each arm per ``dim`` value with absolute and relative lift.

    One aggregation keyed by ``dim`` computes both arms' rates with conditional
    averages (the pivot of the A-side / B-side join); values seen in only one arm are
    dropped, as the inner join drops them. Sorted by relative lift, NULL (control
    rate 0) first. ``with_share`` adds the value's share of all Normal sessions.
    """
    n = normal(clean_df, spec)
    is_a = F.col("test_group") == spec.control
    is_b = F.col("test_group") == spec.treatment
    agg = n.groupBy(dim).agg(
        (F.avg(F.when(is_a, F.col("conversion_flag"))) * 100).alias("rate_a"),
        (F.avg(F.when(is_b, F.col("conversion_flag"))) * 100).alias("rate_b"),
        F.count_if(is_a).alias("n_a"),
        F.count_if(is_b).alias("n_b"),
        F.count("*").alias("n_all"),
    )
    cols = [dim]
    if with_share:
        # share of all sessions (both arms, any value): window over the few aggregated rows
        total = F.sum("n_all").over(Window.partitionBy())
        agg = agg.withColumn("pct_of_traffic", rnd(F.col("n_all") * F.lit(100.0) / total, 2))
        cols.append("pct_of_traffic")
    diff = F.col("rate_b") - F.col("rate_a")
    return (
        agg.filter((F.col("n_a") > 0) & (F.col("n_b") > 0))
        .select(
            *cols,
            rnd("rate_a", 2).alias("group_a_conv_rate"),
            rnd("rate_b", 2).alias("group_b_conv_rate"),
            rnd(diff, 2).alias("absolute_lift"),
            rnd(diff / F.nullif(F.col("rate_a"), F.lit(0.0)) * 100, 1).alias("relative_lift_pct"),
        )
        .orderBy(F.desc_nulls_first("relative_lift_pct"))
    )


def device_lift_share(clean_df: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Device results: traffic share and conversion lift per device."""
    return segment_lift(clean_df, "device_type", with_share=True, spec=spec)
