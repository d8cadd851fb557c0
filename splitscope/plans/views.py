"""Temp views for SQL users.

``register_views`` exposes the raw table, the cleaning view, the per-arm
summary and a one-row ``dual`` under the names analysts already query
(``dashboard_sessions``, ``vw_dashboard_clean``, ``vw_group_summary``), so report SQL written against
those views runs through ``spark.sql`` with Catalyst planning it exactly like
the DataFrame operators. The cleaning view also carries the aliases
``test_group``, ``conversion_flag`` and ``bounce_flag`` that such reports use
for ``group_id``, ``conversion`` and ``bounce``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean
from ..operators.summary import group_summary
from ..spec import DEFAULT_SPEC, ExperimentSpec

DUAL_VIEW = "dual"
RAW_VIEW = "dashboard_sessions"
CLEAN_VIEW = "vw_dashboard_clean"
SUMMARY_VIEW = "vw_group_summary"


def register_views(
    spark: SparkSession, sessions: DataFrame, spec: ExperimentSpec = DEFAULT_SPEC, prefix: str = ""
) -> dict[str, str]:
    """Create (or replace) the three temp views; returns {role: view name}."""
    c = clean(sessions, spec)
    with_aliases = c.withColumns(
        {
            "test_group": F.col("group_id"),
            "conversion_flag": F.col("conversion"),
            "bounce_flag": F.col("bounce"),
        }
    )
    names = {
        "raw": prefix + RAW_VIEW,
        "clean": prefix + CLEAN_VIEW,
        "summary": prefix + SUMMARY_VIEW,
        "dual": prefix + DUAL_VIEW,
    }
    sessions.createOrReplaceTempView(names["raw"])
    with_aliases.createOrReplaceTempView(names["clean"])
    group_summary(c, spec).createOrReplaceTempView(names["summary"])
    # one-row relation for constant SELECTs (Spark SQL has no built-in DUAL)
    spark.range(1).selectExpr("'X' AS dummy").createOrReplaceTempView(names["dual"])
    return names
