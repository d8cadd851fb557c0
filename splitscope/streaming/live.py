"""Structured Streaming: the cleaning view and per-arm KPIs over an arriving session feed.

The batch analyses are defined on a static session table. When sessions arrive
continuously (files landing in a folder), the same cleaning view applies row by
row, and the additive parts of the KPI summary are maintained by Spark's state
store:

* ``live_arm_totals`` keeps running per-arm sufficient statistics (sessions,
  conversions, bounces, sums of engagement metrics) in complete mode; the
  significance test is a column expression on that tiny table, applied per
  micro-batch with ``foreachBatch`` (see ``ztest_from_totals``).
* ``live_daily_trend`` aggregates per calendar day and arm with an event-time
  watermark, so a day's row is emitted once no more late sessions can change it
  and its state is then dropped.

Exact distinct users and exact percentiles need the whole history, so they stay
batch; ``live_arm_totals(approx=True)`` keeps HyperLogLog++ users and approximate
medians in the state store instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import normal_quantile, normal_sf, rnd
from ..operators.clean import clean, normal
from ..session import ensure_checkpoint_dir
from ..sources.sessions import SESSION_SCHEMA, csv_schema, csv_to_sessions
from ..spec import DEFAULT_SPEC, ExperimentSpec


def stream_sessions(spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of session files with the declared schema; CSV files as ``read_sessions_csv``
    reads them (published header, checked in every file)."""
    reader = spark.readStream.format(fmt)
    if fmt == "csv":
        reader = reader.schema(csv_schema()).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    else:
        reader = reader.schema(SESSION_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(path)
    return csv_to_sessions(stream) if fmt == "csv" else stream


def live_arm_totals(
    sessions_stream: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC, approx: bool = False, rsd: float = 0.01
) -> DataFrame:
    """Running per-arm totals over Normal sessions (streaming aggregation).

    ``approx=True`` also keeps HyperLogLog++ distinct users and ``percentile_approx``
    medians in the state store (exact ones need the whole history, so they stay batch).
    """
    n = normal(clean(sessions_stream, spec), spec)
    extra = []
    if approx:
        extra = [
            F.approx_count_distinct("user_id", rsd).alias("users_approx"),
            F.percentile_approx(F.col("time_on_dashboard_clean").cast("double"), 0.5).alias("median_time_approx"),
            F.percentile_approx(F.col("page_load_time_clean").cast("double"), 0.5).alias("median_load_approx"),
        ]
    return n.groupBy("test_group").agg(
        *extra,
        F.count("*").alias("sessions"),
        F.sum("conversion").cast("bigint").alias("conversions"),
        F.sum("bounce").cast("bigint").alias("bounces"),
        F.sum("widgets_viewed").cast("bigint").alias("widgets_sum"),
        F.sum("filters_applied").cast("bigint").alias("filters_sum"),
        F.sum("time_on_dashboard_clean").alias("time_sum"),
        F.sum("page_load_time_clean").alias("load_sum"),
    )


def ztest_from_totals(totals: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Pooled two-proportion z-test on a (static) per-arm totals table: one row."""
    pick = lambda arm, c: F.max(F.when(F.col("test_group") == arm, F.col(c)))
    wide = totals.agg(
        pick(spec.control, "sessions").alias("n_a"),
        pick(spec.treatment, "sessions").alias("n_b"),
        pick(spec.control, "conversions").alias("x_a"),
        pick(spec.treatment, "conversions").alias("x_b"),
    ).filter(F.col("n_a").isNotNull() & F.col("n_b").isNotNull())
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    p_a, p_b = F.col("x_a") / n_a, F.col("x_b") / n_b
    pooled = (F.col("x_a") + F.col("x_b")) / (n_a + n_b)
    se = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / n_a + F.lit(1.0) / n_b))
    z = (p_b - p_a) / F.nullif(se, F.lit(0.0))
    return wide.select(
        "n_a",
        "n_b",
        rnd(p_a * 100, 4).alias("rate_a_pct"),
        rnd(p_b * 100, 4).alias("rate_b_pct"),
        rnd(z, 4).alias("z_statistic"),
        rnd(normal_sf(z), 6).alias("p_value"),
        (z > F.lit(normal_quantile(1 - spec.alpha))).alias("significant"),
    )


def event_time(ts: str = "session_timestamp"):
    """Zone-less wall-clock timestamp as an instant (the wall clock read as UTC).

    Watermarks need TIMESTAMP; going through epoch microseconds keeps day windows on
    wall-clock midnights whatever the session time zone.
    """
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")
    return F.timestamp_micros(micros)


def _utc_day(instant):
    """Calendar date (text) of an instant read in UTC, independent of the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(instant) / F.lit(86_400_000_000)).cast("int")).cast("string")


def live_daily_trend(
    sessions_stream: DataFrame, watermark: str = "2 days", spec: ExperimentSpec = DEFAULT_SPEC
) -> DataFrame:
    """Per day and arm: sessions, conversions, conversion rate; finalized by the watermark."""
    n = normal(clean(sessions_stream, spec), spec).withColumn("event_time", event_time())
    n = n.withWatermark("event_time", watermark)
    return (
        n.groupBy(F.window("event_time", "1 day").alias("day"), "test_group")
        .agg(F.count("*").alias("sessions"), F.sum("conversion").cast("bigint").alias("conversions"))
        .select(
            _utc_day(F.col("day.start")).alias("session_date"),
            "test_group",
            "sessions",
            "conversions",
            rnd(F.col("conversions") * F.lit(100.0) / F.col("sessions"), 2).alias("conversion_rate_pct"),
        )
    )


def start(
    live: DataFrame,
    name: str,
    output_mode: str,
    sink: str = "parquet",
    path: str | None = None,
    trigger_seconds: int | None = None,
):
    """Start a streaming query whose state and progress live under the shared checkpoint folder.

    The checkpoint (offsets, commits, aggregation state) is what lets a restarted
    query resume exactly where it stopped after a driver or executor loss; it is
    placed at ``{spark.checkpoint.dir}/streams/{name}``.
    """
    root = ensure_checkpoint_dir(live.sparkSession).rstrip("/")
    writer = (
        live.writeStream.queryName(name)
        .outputMode(output_mode)
        .format(sink)
        .option("checkpointLocation", f"{root}/streams/{name}")
    )
    if path:
        writer = writer.option("path", path)
    if trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.start()

