"""Time patterns per arm: daily, monthly, weekday and hour-of-day trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import avg_d, pct, rnd
from ..spec import DEFAULT_SPEC, ExperimentSpec
from .clean import normal, weekday_rank


def daily_trend(clean_df: DataFrame, min_sessions: int = 10, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Sessions, conversions and rate per calendar day and arm; days with fewer than
    ``min_sessions`` sessions in an arm are left out (HAVING)."""
    n = normal(clean_df, spec)
    # DATE cast of a zone-less timestamp: same day in every session time zone
    day = F.to_date("session_timestamp").cast("string").alias("session_date")
    return (
        n.groupBy(day, "test_group")
        .agg(
            F.count("*").alias("sessions"),
            F.sum("conversion_flag").cast("bigint").alias("conversions"),
            pct("conversion_flag").alias("conversion_rate_pct"),
        )
        .filter(F.col("sessions") >= min_sessions)
        .orderBy("session_date", "test_group")
    )


def monthly_trend(clean_df: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    n = normal(clean_df, spec)
    return (
        n.groupBy("year_month", "test_group")
        .agg(
            F.count("*").alias("sessions"),
            F.sum("conversion").cast("bigint").alias("conversions"),
            pct("conversion").alias("conversion_rate_pct"),
            pct("bounce").alias("bounce_rate_pct"),
        )
        .orderBy("year_month", "test_group")
    )


def weekday_trend(clean_df: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Per weekday and arm, Monday first."""
    n = normal(clean_df, spec)
    return (
        n.groupBy("day_of_week", "test_group")
        .agg(
            F.count("*").alias("sessions"),
            pct("conversion").alias("conversion_rate_pct"),
            rnd(avg_d("time_on_dashboard_clean"), 1).alias("avg_time_sec"),
        )
        .orderBy(weekday_rank(F.col("day_of_week")), "test_group")
    )


def hourly_trend(clean_df: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    n = normal(clean_df, spec)
    return (
        n.groupBy("hour_of_day", "test_group")
        .agg(F.count("*").alias("sessions"), pct("conversion").alias("conversion_rate_pct"))
        .orderBy("hour_of_day", "test_group")
    )
