"""Readers for the experiment session table.

The session table is the only input of every analysis. Readers enforce an
explicit schema (never ``inferSchema``: it would turn the two-decimal metrics
into doubles) and apply the renames ``timestamp -> session_timestamp`` and
``group -> group_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import DEFAULT_SPEC, ExperimentSpec

SESSION_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("session_timestamp", T.TimestampNTZType(), False),
        T.StructField("group_id", T.StringType(), False),
        T.StructField("device_type", T.StringType(), False),
        T.StructField("country", T.StringType(), False),
        T.StructField("cookie_segment", T.StringType(), False),
        T.StructField("page_load_time_sec", T.DecimalType(6, 2), False),
        T.StructField("widgets_viewed", T.IntegerType(), False),
        T.StructField("filters_applied", T.IntegerType(), False),
        T.StructField("time_on_dashboard_sec", T.DecimalType(7, 2), False),
        T.StructField("bounce", T.IntegerType(), False),
        T.StructField("conversion", T.IntegerType(), False),
    ]
)

# Header of the published CSV, in file order.
CSV_COLUMNS = (
    "user_id", "session_id", "timestamp", "group", "device_type", "country", "cookie_segment",
    "page_load_time_sec", "widgets_viewed", "filters_applied", "time_on_dashboard_sec", "bounce", "conversion",
)
_CSV_RENAMES = {"timestamp": "session_timestamp", "group": "group_id"}


def csv_schema() -> T.StructType:
    """Types of the published CSV, in its column order."""
    by_name = {f.name: f for f in SESSION_SCHEMA.fields}
    return T.StructType(
        [T.StructField(name, by_name[_CSV_RENAMES.get(name, name)].dataType, True) for name in CSV_COLUMNS]
    )


def csv_to_sessions(df: DataFrame) -> DataFrame:
    """Columns of the published CSV under the names of ``SESSION_SCHEMA``; batch and stream."""
    return df.withColumnsRenamed(_CSV_RENAMES).select(*[f.name for f in SESSION_SCHEMA.fields])


def read_sessions_csv(spark: SparkSession, path: str, timestamp_format: str | None = None) -> DataFrame:
    """Load the session CSV (header as published) with an explicit schema, then rename.

    The header is checked against the schema (``enforceSchema=false``): a file with other
    or permuted columns fails instead of loading values under wrong names.
    """
    reader = spark.read.schema(csv_schema()).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    if timestamp_format:
        reader = reader.option("timestampNTZFormat", timestamp_format)
    return csv_to_sessions(reader.csv(path))


# Session times in written CSV files, to the microsecond.
CSV_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_sessions_csv(df: DataFrame, path: str) -> None:
    """Write a session table as CSV with the published header, column order and names; times as ``CSV_TIME``."""
    published = {name: _CSV_RENAMES.get(name, name) for name in CSV_COLUMNS}
    df.select(*[F.col(own).alias(name) for name, own in published.items()]).write.mode("overwrite").option("header", True).option("timestampNTZFormat", CSV_TIME).csv(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Load a Parquet session table (column names of ``SESSION_SCHEMA``).

    Parquet keeps the filter on raw metrics (see ``operators.clean.normal_predicate``)
    pushable to row groups, and prunes columns each analysis does not read.
    """
    return spark.read.schema(SESSION_SCHEMA).parquet(path)


def write_sessions(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a session table as Parquet, optionally partitioned (e.g. by ``year_month``)."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


# Fixed values of the test-data adapter (FIXTURES.md section 2): label lists in rule order.
_COUNTRIES = ("US", "IN", "GB", "DE", "CA", "FR")  # event_id % 7 = 0..5, else Other
_SEGMENTS = ("new_user", "returning_low", "returning_med", "returning_high")  # user_id % 5 = 0..3, else anonymous


def _case(subject: str, labels: tuple[str, ...], other: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(labels))
    return f"CASE {subject} {whens} ELSE '{other}' END"


def sessions_from_events(events: DataFrame) -> DataFrame:
    """Derive one session per ``events`` row (the test tables hold no session table).

    Narrow projections only, no shuffle. The JSON field ``k`` is read with
    ``json_tuple`` (top-level fields, one parse per event): as a generator output it
    is computed once, so the quality filter on the derived load time does not parse
    the JSON again for each reference. The rules are SQL expressions: one call
    builds the whole projection.
    """
    parsed = events.select("*", F.json_tuple(F.col("props"), "k").alias("k_text"))
    return parsed.selectExpr(
        "CAST(event_id AS STRING) AS session_id",
        "CAST(user_id AS STRING) AS user_id",
        "timestampadd(DAY, CAST(event_id % 13 * 28 AS INT), ts) AS session_timestamp",
        "CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS group_id",
        "CASE WHEN event_id % 20 < 12 THEN 'desktop' WHEN event_id % 20 < 19 THEN 'mobile' ELSE 'tablet' END AS device_type",
        f"{_case('event_id % 7', _COUNTRIES, 'Other')} AS country",
        f"{_case('user_id % 5', _SEGMENTS, 'anonymous')} AS cookie_segment",
        "CAST(CAST(k_text AS INT) * CAST(0.11 AS DECIMAL(3,2)) - CAST(0.20 AS DECIMAL(3,2)) AS DECIMAL(6,2))"
        " AS page_load_time_sec",
        "CAST(event_id % 9 AS INT) AS widgets_viewed",
        "CAST(event_id % 11 % 5 AS INT) AS filters_applied",
        "CAST(CAST(value AS DECIMAL(7,2)) * 3 - 5 AS DECIMAL(7,2)) AS time_on_dashboard_sec",
        "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bounce",
        "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS conversion",
    )


EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def load_test_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions derived from ``{sf_dir}/events.parquet`` (declared schema: no footer inference)."""
    return sessions_from_events(spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet"))


def conform(df: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Rename a table described by ``spec`` to the canonical session column names."""
    mapping = {
        spec.session_id: "session_id", spec.user_id: "user_id", spec.timestamp: "session_timestamp",
        spec.arm: "group_id", spec.device: "device_type", spec.country: "country",
        spec.segment: "cookie_segment", spec.load_time: "page_load_time_sec",
        spec.widgets: "widgets_viewed", spec.filters: "filters_applied",
        spec.dwell_time: "time_on_dashboard_sec", spec.bounce: "bounce", spec.conversion: "conversion",
    }
    if all(k == v for k, v in mapping.items()):
        return df
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])
