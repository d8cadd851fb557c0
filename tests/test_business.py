"""ROI projection against the published business case (its internally consistent figures)."""

import math

from helpers import row, sessions

import splitscope as ss


def _published_rates(spark):
    # 8.33% control and 14.82% treatment conversion, one segment
    rows = []
    for arm, conversions in (("A", 833), ("B", 1482)):
        for i in range(10_000):
            rows.append(row(f"{arm}{i}", uid=f"{arm}u{i}", arm=arm, conversion=1 if i < conversions else 0))
    return ss.clean(sessions(spark, rows))


def test_roi_reproduces_the_published_case(spark):
    out = {r.cookie_segment: r for r in ss.roi(_published_rates(spark)).collect()}
    total = out["All"]
    assert (total.rate_a_pct, total.rate_b_pct) == (8.33, 14.82)
    assert total.annual_revenue_a == 24_990_000.0
    assert total.annual_revenue_b == 44_460_000.0
    assert total.annual_revenue_lift == 19_470_000.0
    assert total.total_cost == 110_000.0
    assert total.net_benefit == 19_360_000.0
    assert math.isclose(total.roi_pct, 17_600.0, abs_tol=0.01)
    assert math.isclose(total.payback_months, 0.0678, abs_tol=1e-4)
    assert total.break_even_sessions == 67_797
    assert out["new_user"].annual_revenue_lift == total.annual_revenue_lift  # the only segment


def test_recommendation_for_a_clear_win(spark):
    rec = ss.recommend(_published_rates(spark)).collect()
    assert [(r.cookie_segment, r.recommendation, r.priority) for r in rec] == [("new_user", "ROLL OUT", 1)]
    z = ss.ztest(_published_rates(spark)).first()
    assert z.z_statistic > 12 and z.p_value == 0.0


def test_segment_lift_reproduces_the_published_segment_table(spark):
    from pyspark.sql import functions as F

    from splitscope.sources import SESSION_SCHEMA

    # published conversion rates (%) per segment: control, treatment
    published = {
        "returning_high": (6.75, 14.60),
        "returning_med": (7.72, 14.32),
        "new_user": (8.89, 14.98),
        "returning_low": (9.64, 15.59),
        "anonymous": (9.11, 14.64),
    }
    parts = []
    for seg, (ra, rb) in published.items():
        for arm, rate in (("A", ra), ("B", rb)):
            conv = int(round(rate * 100))  # conversions out of 10,000 sessions
            parts.append(
                spark.range(10_000).select(
                    F.concat(F.lit(f"{seg}-{arm}-"), F.col("id").cast("string")).alias("session_id"),
                    F.concat(F.lit(f"{seg}-{arm}-u"), F.col("id").cast("string")).alias("user_id"),
                    F.lit("2025-03-03 09:00:00").cast("timestamp_ntz").alias("session_timestamp"),
                    F.lit(arm).alias("group_id"),
                    F.lit("desktop").alias("device_type"),
                    F.lit("US").alias("country"),
                    F.lit(seg).alias("cookie_segment"),
                    F.lit("1.00").cast("decimal(6,2)").alias("page_load_time_sec"),
                    F.lit(1).alias("widgets_viewed"),
                    F.lit(1).alias("filters_applied"),
                    F.lit("100.00").cast("decimal(7,2)").alias("time_on_dashboard_sec"),
                    F.lit(0).alias("bounce"),
                    (F.col("id") < conv).cast("int").alias("conversion"),
                )
            )
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    assert [f.name for f in df.schema.fields] == [f.name for f in SESSION_SCHEMA.fields]
    out = ss.segment_lift(ss.clean(df)).collect()
    assert [r.cookie_segment for r in out] == list(published)  # the published row order
    assert [r.relative_lift_pct for r in out] == [116.3, 85.5, 68.5, 61.7, 60.7]
    assert [(r.group_a_conv_rate, r.group_b_conv_rate) for r in out] == list(published.values())
