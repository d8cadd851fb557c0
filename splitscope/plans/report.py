"""Whole-report runs: materialize the cleaned table once, share passes, write results.

A report runs some forty analyses over one session table. Two plan-level
choices keep that cheap at scale:

* ``materialize`` writes the cleaned, column-pruned table once as Parquet under
  the session's ``spark.checkpoint.dir`` (a shared folder on a cluster) and reads
  it back: every analysis then scans native columns with the quality rule pushed
  into the Parquet reader, and the lineage back to the raw source is cut, so a
  lost executor never recomputes the derivation.
* ``profiles`` computes the dimension x arm profiles of several dimensions in one
  ``GROUPING SETS`` aggregation (one scan instead of one per dimension).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as ops
from ..functions.exprs import avg_d, rnd
from ..session import ensure_checkpoint_dir
from ..spec import DEFAULT_SPEC, ExperimentSpec


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` under the checkpoint folder and return a DataFrame reading it back.

    With ``partition_by`` rows are first rebalanced by that column (AQE splits a large
    value over several tasks), so each value gets a few files of good size rather than one
    from every scan task.
    """
    spark = df.sparkSession
    path = _fresh_path(spark, name)
    _write(df, path, partition_by)
    return spark.read.schema(df.schema).parquet(path)


def _fresh_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/splitscope/{name}-{uuid.uuid4().hex[:12]}"


def _write(df: DataFrame, path: str, partition_by: str | None) -> None:
    if partition_by:
        df = df.hint("rebalance", F.col(partition_by))
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    """Delete a folder this module wrote, through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def prepared_clean(sessions: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """The cleaning view, written once (partitioned by month for time-range pruning)."""
    return materialize(ops.clean(sessions, spec), "clean_sessions", partition_by="year_month")


def profiles(
    clean_df: DataFrame,
    dims: Sequence[str] = ("cookie_segment", "device_type", "country", "year_month", "day_of_week", "hour_of_day"),
    spec: ExperimentSpec = DEFAULT_SPEC,
) -> DataFrame:
    """All ``dim x arm`` profiles in one aggregation: columns ``dimension``, ``value``,
    ``test_group`` and the profile measures. Values are cast to string so the
    dimensions share one column."""
    n = ops.normal(clean_df, spec).select(
        "test_group",
        *[F.col(d).cast("string").alias(d) for d in dims],
        "conversion_flag",
        "bounce_flag",
        "widgets_viewed",
        "filters_applied",
        "time_on_dashboard_clean",
        "page_load_time_clean",
    )
    grouped = n.groupingSets([[d, "test_group"] for d in dims], *dims, "test_group").agg(
        F.count("*").alias("sessions"),
        F.sum("conversion_flag").cast("bigint").alias("conversions"),
        F.avg("conversion_flag").alias("conv"),
        F.avg("bounce_flag").alias("bnc"),
        avg_d("widgets_viewed").alias("w"),
        avg_d("filters_applied").alias("f"),
        avg_d("time_on_dashboard_clean").alias("t"),
        avg_d("page_load_time_clean").alias("l"),
        *[F.grouping(d).alias(f"in_{d}") for d in dims],
    )
    # which dimension a row belongs to: the one column that is not aggregated away (its
    # value may itself be NULL)
    dim_name = F.coalesce(*[F.when(F.col(f"in_{d}") == 0, F.lit(d)) for d in dims])
    dim_value = F.coalesce(*[F.when(F.col(f"in_{d}") == 0, F.col(d)) for d in dims])
    return grouped.select(
        dim_name.alias("dimension"),
        dim_value.alias("value"),
        "test_group",
        "sessions",
        "conversions",
        rnd(F.col("conv") * 100, 2).alias("conversion_rate_pct"),
        rnd(F.col("bnc") * 100, 2).alias("bounce_rate_pct"),
        rnd("w", 2).alias("avg_widgets"),
        rnd("f", 2).alias("avg_filters"),
        rnd("t", 1).alias("avg_time_sec"),
        rnd("l", 2).alias("avg_load_time"),
    )


def analyses(spec: ExperimentSpec = DEFAULT_SPEC) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Every report analysis over the cleaned table, by name."""
    return {
        "balance_device": lambda c: ops.balance(c, "device_type", "pct_within_device"),
        "balance_segment": lambda c: ops.balance(c, "cookie_segment", "pct_within_segment"),
        "contingency_segment": lambda c: ops.contingency(c, "cookie_segment"),
        "randomization_chi2": lambda c: ops.randomization_test(c, "cookie_segment", spec=spec),
        "prep_summary": lambda c: ops.prep_summary(c, spec),
        "quality_breakdown": ops.quality_breakdown,
        "group_summary": lambda c: ops.group_summary(c, spec),
        "kpi_lift": lambda c: ops.kpi_lift(c, spec),
        "distribution_percentiles": lambda c: ops.distribution(c, spec=spec),
        "widget_histogram": lambda c: ops.histogram(c, spec=spec),
        "profiles": lambda c: profiles(c, spec=spec),
        "segment_lift": lambda c: ops.segment_lift(c, spec=spec),
        "device_lift_share": lambda c: ops.device_lift_share(c, spec),
        "rate_by_widgets": lambda c: ops.rate_by_level(c, "widgets_viewed", spec),
        "rate_by_filters": lambda c: ops.level_counts(c, "filters_applied", spec),
        "time_buckets": lambda c: ops.time_buckets(c, spec=spec),
        "daily_trend": lambda c: ops.daily_trend(c, spec=spec),
        "user_summary": lambda c: ops.user_summary(c, spec),
        "sessions_to_conversion": lambda c: ops.sessions_to_conversion(c, spec=spec),
        "funnel": lambda c: ops.funnel(c, spec=spec),
        "touch_attribution": lambda c: ops.touch_attribution(c, spec=spec),
        "ztest_conversion": lambda c: ops.ztest(c, spec=spec),
        "chi2_conversion": lambda c: ops.chi2_outcome(c, spec=spec),
        "ztest_by_segment": lambda c: ops.stratified_test(c, spec=spec),
        "simpson_check": lambda c: ops.simpson_check(c, spec=spec),
        "metric_comparison": lambda c: ops.metric_comparison(c, spec=spec),
        "correlations": lambda c: ops.correlations(c, spec=spec),
        "logit_model": lambda c: ops.logit_model(c, spec=spec),
        "driver_model": lambda c: ops.driver_model(c, spec=spec),
        "device_interaction": lambda c: ops.interaction(c, spec=spec),
        "power_by_segment": lambda c: ops.power_analysis(c, spec=spec),
        "sensitivity": lambda c: ops.sensitivity(c, spec=spec),
        "firth_model": lambda c: ops.firth_model(c, spec=spec),
        "interaction_test": lambda c: ops.interaction_test(c, spec=spec),
        "adjusted_effect": lambda c: ops.adjusted_effect(c, spec=spec),
        "chain_attribution": lambda c: ops.chain_attribution(c, spec=spec),
        "roi_by_segment": lambda c: ops.roi(c, spec=spec),
        "segment_recommendation": lambda c: ops.recommend(c, spec=spec),
        "findings": lambda c: ops.findings(c, spec),
    }


def run_report(
    spark: SparkSession,
    sessions: DataFrame,
    out_dir: str | None = None,
    names: Sequence[str] | None = None,
    spec: ExperimentSpec = DEFAULT_SPEC,
) -> dict[str, DataFrame]:
    """Run the analyses over a once-materialized cleaned table.

    With ``out_dir`` each (small) result is written as Parquet to ``out_dir/<name>``, the
    returned DataFrames read those files, and the cleaned copy is deleted at the end.
    Without it the results stay lazy and read the copy, which then stays.
    """
    path = _fresh_path(spark, "clean_sessions")
    clean = ops.clean(sessions, spec)
    _write(clean, path, "year_month")
    c = spark.read.schema(clean.schema).parquet(path)
    todo = analyses(spec)
    results = {}
    try:
        for name in names or list(todo):
            df = todo[name](c)
            if out_dir:
                target = f"{out_dir.rstrip('/')}/{name}"
                # written as planned: AQE coalesces these small outputs into few files and keeps
                # the range-partitioned order; coalesce(1) would run the final aggregation in one
                # task, repartition(1) would drop the order
                df.write.mode("overwrite").parquet(target)
                df = spark.read.parquet(target)
            results[name] = df
    finally:
        if out_dir:
            _drop(spark, path)
    return results
