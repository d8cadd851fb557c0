"""Cleaning view: clamps, engagement flags, tiers, calendar parts and the quality flag.

``clean`` is one narrow projection (no shuffle). ``normal`` keeps the rows every
metric analysis uses; it states the quality rule on the raw metric columns so
Catalyst pushes it through the projection into the Parquet scan as a row-group
filter (the CASE form of ``data_quality`` cannot be pushed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sessions import conform
from ..spec import DEFAULT_SPEC, QUALITY_LABELS, TIER_LABELS, ExperimentSpec

# English weekday names, indexed by Spark's dayofweek (1 = Sunday).
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
# Monday-first display rank, by name.
WEEKDAY_RANK = {"Monday": 1, "Tuesday": 2, "Wednesday": 3, "Thursday": 4, "Friday": 5, "Saturday": 6, "Sunday": 7}

ANOMALY, OUTLIER, QUALITY_NORMAL = QUALITY_LABELS


def _num(v: float) -> str:
    return repr(int(v)) if float(v).is_integer() else repr(float(v))


def weekday_name_sql(ts: str) -> str:
    """Full English weekday of a (zone-less) timestamp; independent of the session time zone."""
    names = ", ".join(f"'{d}'" for d in WEEKDAYS)
    return f"element_at(array({names}), dayofweek(to_date({ts})))"


def weekday_rank(day: Column) -> Column:
    expr = None
    for name, rank in WEEKDAY_RANK.items():
        expr = F.when(day == name, rank) if expr is None else expr.when(day == name, rank)
    return expr


def quality_sql(load: str, dwell: str, spec: ExperimentSpec = DEFAULT_SPEC) -> str:
    """Anomaly (any metric below its floor) before Outlier (any above its cap); NULLs are Normal."""
    (load_lo, load_hi), (dwell_lo, dwell_hi) = spec.load_bounds, spec.dwell_bounds
    return (
        f"CASE WHEN {load} < {_num(load_lo)} OR {dwell} < {_num(dwell_lo)} THEN '{ANOMALY}' "
        f"WHEN {load} > {_num(load_hi)} OR {dwell} > {_num(dwell_hi)} THEN '{OUTLIER}' "
        f"ELSE '{QUALITY_NORMAL}' END"
    )


def normal_sql(load: str, dwell: str, spec: ExperimentSpec = DEFAULT_SPEC) -> str:
    """``quality = 'Normal'`` rewritten as range tests that Parquet can evaluate."""
    (load_lo, load_hi), (dwell_lo, dwell_hi) = spec.load_bounds, spec.dwell_bounds
    return (
        f"({load} IS NULL OR {load} BETWEEN {_num(load_lo)} AND {_num(load_hi)}) AND "
        f"({dwell} IS NULL OR {dwell} BETWEEN {_num(dwell_lo)} AND {_num(dwell_hi)})"
    )


def quality_flag(load: str, dwell: str, spec: ExperimentSpec = DEFAULT_SPEC) -> Column:
    return F.expr(quality_sql(load, dwell, spec))


def normal_predicate(load: str, dwell: str, spec: ExperimentSpec = DEFAULT_SPEC) -> Column:
    return F.expr(normal_sql(load, dwell, spec))


def _clamp_sql(x: str, lo: float, hi: float, type_: str) -> str:
    """``<lo -> lo``, ``>hi -> hi``, else value; NULL stays NULL (unlike ``greatest/least``)."""
    return f"CAST(CASE WHEN {x} < {_num(lo)} THEN {_num(lo)} WHEN {x} > {_num(hi)} THEN {_num(hi)} ELSE {x} END AS {type_})"


def clean(sessions: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """The cleaning view over a session table described by ``spec``.

    One projection written as SQL expressions (one call builds it); clamps keep the
    source type of each metric.
    """
    df = conform(sessions, spec)
    types = dict(df.dtypes)
    load, dwell, ts = "page_load_time_sec", "time_on_dashboard_sec", "session_timestamp"
    return df.selectExpr(
        "session_id",
        "user_id",
        ts,
        "group_id",
        "device_type",
        "country",
        "cookie_segment",
        f"{load} AS page_load_time_raw",
        f"{dwell} AS time_on_dashboard_raw",
        f"{_clamp_sql(load, *spec.load_bounds, types[load])} AS page_load_time_clean",
        f"{_clamp_sql(dwell, *spec.dwell_bounds, types[dwell])} AS time_on_dashboard_clean",
        "widgets_viewed",
        "filters_applied",
        "bounce",
        "conversion",
        "CASE WHEN widgets_viewed > 0 THEN 1 ELSE 0 END AS widget_engaged",
        "CASE WHEN filters_applied > 0 THEN 1 ELSE 0 END AS filter_engaged",
        f"CASE WHEN {dwell} >= {_num(spec.tier_high)} THEN '{TIER_LABELS[0]}' "
        f"WHEN {dwell} >= {_num(spec.tier_medium)} THEN '{TIER_LABELS[1]}' ELSE '{TIER_LABELS[2]}' END AS engagement_tier",
        f"date_format(to_date({ts}), 'yyyy-MM') AS year_month",
        f"{weekday_name_sql(ts)} AS day_of_week",
        f"hour({ts}) AS hour_of_day",
        f"{quality_sql(load, dwell, spec)} AS data_quality",
    )


def normal(clean_df: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Rows with ``data_quality = 'Normal'``, filtered on the raw metrics (pushable).

    Also exposes the analysis aliases ``test_group``, ``conversion_flag`` and
    ``bounce_flag`` that the reports use for ``group_id``, ``conversion`` and ``bounce``.
    """
    return clean_df.filter(normal_sql("page_load_time_raw", "time_on_dashboard_raw", spec)).selectExpr(
        "*", "group_id AS test_group", "conversion AS conversion_flag", "bounce AS bounce_flag"
    )
