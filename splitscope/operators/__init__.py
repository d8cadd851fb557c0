"""Analysis operators: each is a function from DataFrame to DataFrame."""

from .clean import clean, normal, normal_predicate, quality_flag
from .randomization import balance, chi_square, contingency, observed_cells, quality_checks, randomization_test
from .summary import group_summary, kpi_lift, prep_summary, quality_breakdown
from .distribution import binned, distribution, exact_percentiles, histogram, level_counts, rate_by_level, time_buckets
from .funnel import funnel
from .journey import chain_attribution, first_conversion, first_rows, sessions_to_conversion, touch_attribution, touch_transitions
from .journey import user_rollup, user_summary
from .segments import country_profile, device_lift_share, device_profile, profile, segment_lift, segment_profile
from .temporal import daily_trend, hourly_trend, monthly_trend, weekday_trend
from .business import findings, recommend, roi
from .inference import chi2_outcome, correlations, metric_comparison, power_analysis, sensitivity, simpson_check
from .inference import stratified_test, ztest
from .model import adjusted_effect, covariate_cells, driver_model, firth_model, interaction, interaction_test, logit_model

__all__ = [
    "clean",
    "normal",
    "normal_predicate",
    "quality_flag",
    "balance",
    "chi_square",
    "contingency",
    "observed_cells",
    "quality_checks",
    "randomization_test",
    "group_summary",
    "kpi_lift",
    "prep_summary",
    "quality_breakdown",
    "binned",
    "distribution",
    "exact_percentiles",
    "histogram",
    "level_counts",
    "rate_by_level",
    "time_buckets",
    "funnel",
    "first_conversion",
    "sessions_to_conversion",
    "touch_attribution",
    "user_rollup",
    "user_summary",
    "country_profile",
    "device_lift_share",
    "device_profile",
    "profile",
    "segment_lift",
    "segment_profile",
    "daily_trend",
    "hourly_trend",
    "monthly_trend",
    "weekday_trend",
    "findings",
    "recommend",
    "roi",
    "chi2_outcome",
    "correlations",
    "metric_comparison",
    "power_analysis",
    "sensitivity",
    "simpson_check",
    "stratified_test",
    "ztest",
    "covariate_cells",
    "interaction",
    "driver_model",
    "logit_model",
    "firth_model",
    "adjusted_effect",
    "interaction_test",
    "chain_attribution",
    "touch_transitions",
    "first_rows",
]
