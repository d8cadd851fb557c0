"""Plan-level helpers: SQL views, whole-report runs, plan inspection."""

from .report import analyses, materialize, prepared_clean, profiles, run_report
from .views import register_views

__all__ = ["analyses", "materialize", "prepared_clean", "profiles", "register_views", "run_report"]
