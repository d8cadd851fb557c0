"""splitscope: two-arm experiment analytics as Spark DataFrame jobs.

Every analysis is a plain function ``DataFrame -> DataFrame`` over the cleaned
session table, built from Spark SQL functions; only small result rows ever reach
the driver.
"""

from . import functions, operators, sources
from .operators import *  # noqa: F401,F403  (every analysis at package level: ss.group_summary, ...)
from .sources import *  # noqa: F401,F403
from .spec import DEFAULT_ROI, DEFAULT_SPEC, PERCENTILES, TIME_BUCKETS, WIDGET_BINS, ExperimentSpec, RoiAssumptions

__all__ = [
    *operators.__all__,
    *sources.__all__,
    "functions",
    "DEFAULT_ROI",
    "DEFAULT_SPEC",
    "PERCENTILES",
    "TIME_BUCKETS",
    "WIDGET_BINS",
    "ExperimentSpec",
    "RoiAssumptions",
]
