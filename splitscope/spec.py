"""Experiment description: column names, arm labels, clamps and bins.

Every operator takes the column names it reads from an ``ExperimentSpec`` so the
same analyses run on any two-arm session table, not only the sample one.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Bin:
    """One labelled bin: ``lo <= x < hi`` (``None`` = open end), or ``lo <= x <= hi`` when ``closed``."""

    label: str
    lo: float | None = None
    hi: float | None = None
    closed: bool = False


@dataclass(frozen=True)
class ExperimentSpec:
    # source columns (after the reader's renames of ``timestamp`` / ``group``)
    session_id: str = "session_id"
    user_id: str = "user_id"
    timestamp: str = "session_timestamp"
    arm: str = "group_id"
    device: str = "device_type"
    country: str = "country"
    segment: str = "cookie_segment"
    load_time: str = "page_load_time_sec"
    dwell_time: str = "time_on_dashboard_sec"
    widgets: str = "widgets_viewed"
    filters: str = "filters_applied"
    bounce: str = "bounce"
    conversion: str = "conversion"

    # arm labels
    control: str = "A"
    treatment: str = "B"

    # cleaning rule: metrics outside [lo, hi] are clamped, and flag the row
    load_bounds: tuple[float, float] = (0, 10)
    dwell_bounds: tuple[float, float] = (0, 600)
    # engagement tiers on the raw dwell time: >= high -> High, >= medium -> Medium
    tier_high: float = 300
    tier_medium: float = 120

    # significance level for every test
    alpha: float = 0.05

    @property
    def arms(self) -> tuple[str, str]:
        return (self.control, self.treatment)


DEFAULT_SPEC = ExperimentSpec()

# Bin labels and edges of the widget histogram and the dwell-time
# buckets, as the analysis defines them. Labels sort in binary string order.
WIDGET_BINS: tuple[Bin, ...] = (
    Bin("0 widgets", 0, 0, closed=True),
    Bin("1-2 widgets", 1, 2, closed=True),
    Bin("3-4 widgets", 3, 4, closed=True),
    Bin("5-6 widgets", 5, 6, closed=True),
    Bin("7+ widgets"),  # everything else, NULL and negatives included
)
TIME_BUCKETS: tuple[Bin, ...] = (
    Bin("< 1 min", None, 60),
    Bin("1-2 min", None, 120),
    Bin("2-3 min", None, 180),
    Bin("3-5 min", None, 300),
    Bin("5+ min"),
)

# Labels the reports print, as the analysis defines them.
QUALITY_LABELS = ("Anomaly", "Outlier", "Normal")  # below a floor, above a cap, otherwise
TIER_LABELS = ("High", "Medium", "Low")  # dwell time >= tier_high, >= tier_medium, otherwise
PREP_STATUS = "Data Preparation Complete"
RANDOMIZATION_VERDICTS = (
    "REJECT NULL - Groups are NOT randomly assigned",
    "ACCEPT NULL - Groups appear randomly assigned",
)
FINDINGS_TITLE = "EDA COMPLETE - KEY FINDINGS"
FINDINGS_BALANCED = "3. Test groups are well-balanced across segments"
FINDINGS_READY = "4. Ready for statistical significance testing"

# Percentile levels of the distribution report.
PERCENTILES: tuple[float, ...] = (0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


@dataclass(frozen=True)
class RoiAssumptions:
    """Business-case inputs of the ROI projection (defaults from the published case)."""

    monthly_sessions: float = 1_000_000
    order_value: float = 25.0
    implementation_cost: float = 50_000.0
    monthly_maintenance: float = 5_000.0
    months: int = 12


DEFAULT_ROI = RoiAssumptions()
