"""Cleaning view: clamps, tiers, quality precedence, bins, the pushable Normal rule."""

import datetime as dt

from helpers import BASE_TS, row, sessions
from pyspark.sql import functions as F

import splitscope as ss
from splitscope.operators.clean import normal_predicate
from splitscope.operators.distribution import binned
from splitscope.spec import TIME_BUCKETS, WIDGET_BINS

LOADS = ["-0.01", "0", "10", "10.01", None]
TIMES = ["-0.01", "0", "59.99", "60", "119.99", "120", "179.99", "180", "299.99", "300", "600", "600.01", None]


def _grid(spark):
    rows = []
    i = 0
    for load in LOADS:
        for time in TIMES:
            rows.append(row(f"s{i}", load=load, time=time))
            i += 1
    return ss.clean(sessions(spark, rows))


def _num(v):
    return None if v is None else float(v)


def test_clamps_tiers_quality(spark):
    out = {r.session_id: r for r in _grid(spark).collect()}
    i = 0
    for load in LOADS:
        for time in TIMES:
            r = out[f"s{i}"]
            i += 1
            lv, tv = _num(load), _num(time)
            exp_load = None if lv is None else min(max(lv, 0.0), 10.0)
            exp_time = None if tv is None else min(max(tv, 0.0), 600.0)
            assert _num(r.page_load_time_clean) == exp_load
            assert _num(r.time_on_dashboard_clean) == exp_time
            tier = "High" if (tv is not None and tv >= 300) else "Medium" if (tv is not None and tv >= 120) else "Low"
            assert r.engagement_tier == tier
            if (lv is not None and lv < 0) or (tv is not None and tv < 0):
                q = "Anomaly"
            elif (lv is not None and lv > 10) or (tv is not None and tv > 600):
                q = "Outlier"
            else:
                q = "Normal"
            assert r.data_quality == q, (load, time)


def test_pushable_normal_rule_equals_case(spark):
    df = _grid(spark)
    pred = normal_predicate("page_load_time_raw", "time_on_dashboard_raw")
    bad = df.filter((F.col("data_quality") == "Normal") != F.coalesce(pred, F.lit(False))).count()
    assert bad == 0
    assert ss.normal(df).count() == df.filter("data_quality = 'Normal'").count()


def test_calendar_parts_are_zone_free(spark):
    ts = dt.datetime(2025, 3, 9, 2, 30, 0)  # inside a US DST gap
    df = ss.clean(sessions(spark, [row("s1", ts=ts)]))
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/Los_Angeles", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            r = df.select("year_month", "day_of_week", "hour_of_day").first()
            assert (r.year_month, r.day_of_week, r.hour_of_day) == ("2025-03", "Sunday", 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_widget_bins_and_time_buckets(spark):
    vals = [0, 1, 2, 3, 4, 5, 6, 7, -1, None]
    df = spark.createDataFrame([(v,) for v in vals], "w int")
    got = [r.b for r in df.select(binned("w", WIDGET_BINS).alias("b")).collect()]
    assert got == [
        "0 widgets", "1-2 widgets", "1-2 widgets", "3-4 widgets", "3-4 widgets", "5-6 widgets", "5-6 widgets",
        "7+ widgets", "7+ widgets", "7+ widgets",
    ]
    tvals = [0.0, 59.99, 60.0, 119.99, 120.0, 179.99, 180.0, 299.99, 300.0, 600.0]
    tdf = spark.createDataFrame([(v,) for v in tvals], "t double")
    got = [r.b for r in tdf.select(binned("t", TIME_BUCKETS).alias("b")).collect()]
    assert got == ["< 1 min", "< 1 min", "1-2 min", "1-2 min", "2-3 min", "2-3 min", "3-5 min", "3-5 min", "5+ min", "5+ min"]


def test_weekday_names(spark):
    rows = [row(f"s{i}", ts=BASE_TS + dt.timedelta(days=i)) for i in range(7)]
    got = [r.day_of_week for r in ss.clean(sessions(spark, rows)).orderBy("session_timestamp").collect()]
    assert got == ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
