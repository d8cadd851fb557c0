"""Incremental (Structured Streaming) forms of the additive analyses."""

from .live import live_arm_totals, live_daily_trend, start, stream_sessions, ztest_from_totals

__all__ = ["live_arm_totals", "live_daily_trend", "start", "stream_sessions", "ztest_from_totals"]
