"""Randomization checks: arm balance, contingency table, chi-square test, data-quality checks.

All run on every row (no quality filter). Each first aggregates sessions to the
``dim x arm`` cells (map-side combined, a few rows per task), and every window
below runs on those few cells only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import chi2_critical_col, chi2_sf, rnd
from ..spec import DEFAULT_SPEC, RANDOMIZATION_VERDICTS, ExperimentSpec
from .common import share_of


# Fixed value: an arm's share may differ from an equal split by one percentage point.
BALANCE_TOLERANCE = 0.01


def balance(clean_df: DataFrame, dim: str, share_name: str | None = None) -> DataFrame:
    """Sessions per ``dim x arm`` and the arm's share within each ``dim`` value."""
    share_name = share_name or f"pct_within_{dim}"
    return (
        clean_df.groupBy(dim, "group_id")
        .agg(F.count("*").alias("sessions"))
        .select(dim, "group_id", "sessions", share_of("sessions", dim).alias(share_name))
        .orderBy(dim, "group_id")
    )


def observed_cells(df: DataFrame, dim: str, arm: str = "group_id") -> DataFrame:
    """``dim x arm`` observed counts (the only pass over the sessions)."""
    return df.groupBy(dim, arm).agg(F.count("*").alias("observed"))


def with_expected(cells: DataFrame, dim: str, arm: str) -> DataFrame:
    """Adds the independence expectation ``row total * column total / total`` to each cell."""
    row_total = F.sum("observed").over(Window.partitionBy(dim)).cast("double")
    col_total = F.sum("observed").over(Window.partitionBy(arm)).cast("double")
    total = F.sum("observed").over(Window.partitionBy()).cast("double")
    return cells.withColumn("expected", row_total * col_total / total)


def contingency(clean_df: DataFrame, dim: str = "cookie_segment", arm: str = "group_id") -> DataFrame:
    """Observed and expected (independence) count per ``dim x arm`` cell."""
    cells = observed_cells(clean_df, dim, arm)
    return with_expected(cells, dim, arm).select(dim, arm, "observed", "expected").orderBy(dim, arm)


def chi_square(cells: DataFrame, dim: str, arm: str, alpha: float) -> DataFrame:
    """Pearson chi-square of independence over aggregated cells: one row.

    ``df = (rows - 1) * (columns - 1)`` from the observed levels; the critical value is
    found for that df and ``alpha``; the p-value uses the closed-form tail. Only observed
    cells count (GROUP BY semantics): a level that an arm never shows adds no term.
    """
    comp = with_expected(cells, dim, arm).select(
        dim,
        arm,
        (F.pow(F.col("observed") - F.col("expected"), 2) / F.nullif(F.col("expected"), F.lit(0.0))).alias("component"),
    )
    stats = comp.agg(
        F.sum("component").alias("stat"),
        ((F.count_distinct(dim) - 1) * (F.count_distinct(arm) - 1)).cast("bigint").alias("dof"),
    )
    return stats.select(
        F.col("stat"),
        F.col("dof"),
        chi2_critical_col("dof", alpha).alias("critical_value"),
        chi2_sf("stat", "dof").alias("p_value"),
    )


def rejects() -> Column:
    """Reject independence: statistic above the critical value."""
    return F.col("stat") > F.col("critical_value")


def randomization_test(
    clean_df: DataFrame, dim: str = "cookie_segment", arm: str = "group_id", spec: ExperimentSpec = DEFAULT_SPEC
) -> DataFrame:
    """Is arm assignment independent of ``dim``? Statistic, df, verdict."""
    res = chi_square(observed_cells(clean_df, dim, arm), dim, arm, spec.alpha)
    return res.select(
        rnd("stat", 4).alias("chi_square_statistic"),
        F.col("dof").alias("degrees_of_freedom"),
        F.when(rejects(), RANDOMIZATION_VERDICTS[0])
        .otherwise(RANDOMIZATION_VERDICTS[1])
        .alias("randomization_conclusion"),
        F.col("critical_value"),
        rnd("p_value", 6).alias("p_value"),
    )


def quality_checks(sessions: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """Data-quality assurance: one row per column with its NULL count, plus table-level checks.

    Output rows ``(check, value)``: ``rows``, ``null_<column>`` for every column,
    ``duplicate_session_ids`` (rows minus distinct ids), ``sessions_<arm>`` and
    ``pct_<arm>`` per arm, ``arms_balanced`` (1 if every arm's share is within one
    percentage point of an equal split, else 0). One aggregation for the null counts; the distinct
    session count is its own two-step aggregation (shuffle by session id).
    """
    cols = sessions.columns
    nulls = sessions.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols],
        *[F.count_if(F.col("group_id") == a).alias(f"sessions_{a}") for a in spec.arms],
    )
    distinct_ids = sessions.select("session_id").distinct().agg(F.count("*").alias("distinct_session_ids"))
    # one row beside one row
    wide = nulls.withColumn("_one", F.lit(1)).join(distinct_ids.withColumn("_one", F.lit(1)), "_one")
    pairs = [("rows", F.col("rows"))]
    pairs += [(f"null_{c}", F.col(f"null_{c}")) for c in cols]
    pairs.append(("duplicate_session_ids", F.col("rows") - F.col("distinct_session_ids")))
    pairs += [(f"sessions_{a}", F.col(f"sessions_{a}")) for a in spec.arms]
    checks = [F.struct(F.lit(name).alias("check"), v.cast("double").alias("value")) for name, v in pairs]
    checks += [
        F.struct(
            F.lit(f"pct_{a}").alias("check"),
            rnd(F.col(f"sessions_{a}") * F.lit(100.0) / F.nullif(F.col("rows"), F.lit(0)), 2).alias("value"),
        )
        for a in spec.arms
    ]
    equal = 1.0 / len(spec.arms)
    off = [F.abs(F.col(f"sessions_{a}") / F.nullif(F.col("rows"), F.lit(0)) - F.lit(equal)) for a in spec.arms]
    balanced = F.greatest(*off) <= F.lit(BALANCE_TOLERANCE)
    checks.append(F.struct(F.lit("arms_balanced").alias("check"), F.when(balanced, 1.0).when(~balanced, 0.0).alias("value")))
    return wide.select(F.explode(F.array(*checks)).alias("c")).select("c.check", "c.value")
