"""The analyses run on any session table described by an ExperimentSpec."""

from conftest import SF01
from pyspark.sql import functions as F

import splitscope as ss
from splitscope.spec import ExperimentSpec

SPEC = ExperimentSpec(
    session_id="sid",
    user_id="visitor",
    timestamp="started_at",
    arm="variant",
    device="platform",
    segment="cohort",
    load_time="load_s",
    dwell_time="dwell_s",
    conversion="purchased",
    control="ctl",
    treatment="trt",
)


def _renamed(spark):
    s = ss.load_test_sessions(spark, SF01)
    return s.select(
        F.col("session_id").alias("sid"),
        F.col("user_id").alias("visitor"),
        F.col("session_timestamp").alias("started_at"),
        F.when(F.col("group_id") == "A", "ctl").otherwise("trt").alias("variant"),
        F.col("device_type").alias("platform"),
        "country",
        F.col("cookie_segment").alias("cohort"),
        F.col("page_load_time_sec").alias("load_s"),
        "widgets_viewed",
        "filters_applied",
        F.col("time_on_dashboard_sec").alias("dwell_s"),
        "bounce",
        F.col("conversion").alias("purchased"),
    )


def test_custom_columns_and_arm_labels(spark):
    base = ss.clean(ss.load_test_sessions(spark, SF01))
    custom = ss.clean(_renamed(spark), SPEC)
    z0, z1 = ss.ztest(base).first(), ss.ztest(custom, spec=SPEC).first()
    assert (z0.z_statistic, z0.p_value, z0.ci_low_pp) == (z1.z_statistic, z1.p_value, z1.ci_low_pp)
    lift0 = sorted(tuple(r)[1:] for r in ss.kpi_lift(base).collect())
    lift1 = sorted(tuple(r)[1:] for r in ss.kpi_lift(custom, SPEC).collect())
    assert lift0 == lift1
    seg0 = [tuple(r) for r in ss.segment_lift(base).collect()]
    seg1 = [tuple(r) for r in ss.segment_lift(custom, spec=SPEC).collect()]
    assert seg0 == seg1
    f1 = [r.status for r in ss.findings(custom, SPEC).collect()]
    assert f1[1].startswith("1. Group trt shows")


def test_custom_bounds_change_the_quality_rule(spark):
    tight = ExperimentSpec(load_bounds=(0, 5), dwell_bounds=(0, 300))
    c = ss.clean(ss.load_test_sessions(spark, SF01), tight)
    stats = c.agg(F.max("page_load_time_clean").alias("l"), F.max("time_on_dashboard_clean").alias("t")).first()
    assert float(stats.l) == 5.0 and float(stats.t) == 300.0
    n = ss.normal(c, tight).agg(F.max("page_load_time_raw").alias("l")).first()
    assert float(n.l) <= 5.0
