"""Engagement funnel per arm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import flag, rnd
from ..spec import DEFAULT_SPEC, ExperimentSpec
from .clean import normal


def default_steps() -> list[tuple[str, Column]]:
    """(count column name, 0/1 step flag) in funnel order."""
    return [
        ("no_bounce", flag(F.col("bounce") == 0)),
        ("viewed_widgets", F.col("widget_engaged")),
        ("applied_filters", F.col("filter_engaged")),
        ("converted", F.col("conversion")),
    ]


# Ratio column names of the four-step funnel, step k over step k-1.
FUNNEL_RATIOS = ("pct_widget_of_engaged", "pct_filter_of_widget", "pct_convert_of_filter")


def funnel(
    clean_df: DataFrame,
    steps: Sequence[tuple[str, Column]] | None = None,
    ratio_names: Sequence[str] = FUNNEL_RATIOS,
    strict: bool = False,
    spec: ExperimentSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Sessions reaching each step, per arm, and each step's ratio to the step before.

    Steps are independent flags, so a ratio can exceed 100%. ``strict=True`` nests
    them instead (a session reaches step k only if it reached step k-1).
    """
    steps = list(steps or default_steps())
    n = normal(clean_df, spec)
    flags = []
    prev = None
    for name, f in steps:
        cur = f if (prev is None or not strict) else flag((prev == 1) & (f == 1))
        flags.append((name, cur))
        prev = cur
    aggs = [F.count("*").alias("total_sessions")]
    aggs += [F.sum(f).cast("bigint").alias(name) for name, f in flags]
    first = steps[0][0]
    aggs.append(rnd(F.avg(flags[0][1]) * 100, 2).alias(f"pct_{first}"))
    out = n.groupBy("test_group").agg(*aggs)
    ratio_cols = [
        rnd(F.col(cur) * F.lit(100.0) / F.nullif(F.col(prev_name), F.lit(0)), 2).alias(ratio)
        for (prev_name, _), (cur, _), ratio in zip(steps, steps[1:], ratio_names)
    ]
    return out.select(
        "test_group",
        "total_sessions",
        *[name for name, _ in steps],
        f"pct_{first}",
        *ratio_cols,
    ).orderBy("test_group")
