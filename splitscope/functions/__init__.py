from .exprs import (
    avg_d,
    chi2_critical_col,
    chi2_sf,
    flag,
    normal_cdf,
    normal_quantile,
    normal_sf,
    pct,
    rnd,
    stddev0,
    two_sided_p,
)

__all__ = [
    "avg_d",
    "chi2_critical_col",
    "chi2_sf",
    "flag",
    "normal_cdf",
    "normal_quantile",
    "normal_sf",
    "pct",
    "rnd",
    "stddev0",
    "two_sided_p",
]
