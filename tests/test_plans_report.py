"""Views for SQL users, the one-pass profile table, the materialized report run, streaming."""

import pyspark.sql.functions as F
from conftest import SF001, SF01

import splitscope as ss
from splitscope import plans
from splitscope.plans.inspect import scan_count
from splitscope.streaming import live_arm_totals, live_daily_trend, stream_sessions, ztest_from_totals


def test_sql_views_run_report_sql(spark):
    sessions = ss.load_test_sessions(spark, SF01)
    plans.register_views(spark, sessions)
    c = ss.clean(sessions)
    # the views carry the cleaned rows under both the stored and the report's names
    view = spark.table("vw_dashboard_clean")
    assert {"test_group", "group_id", "conversion", "conversion_flag", "data_quality"} <= set(view.columns)
    assert view.count() == c.count() and view.filter("test_group <> group_id OR conversion_flag <> conversion").isEmpty()
    worst = spark.sql("SELECT max_by(country, time_on_dashboard_clean) AS c, COUNT_IF(data_quality = 'Normal') AS n FROM vw_dashboard_clean").first()
    assert worst.n == c.filter("data_quality = 'Normal'").count() and worst.c is not None
    summary = spark.sql("SELECT * FROM vw_group_summary").collect()
    assert summary == ss.group_summary(c).collect()


def test_profiles_one_pass_equals_separate(spark):
    c = ss.clean(ss.load_test_sessions(spark, SF01))
    allp = plans.profiles(c)
    assert scan_count(allp) == 1
    got = {
        (r.value, r.test_group): (r.sessions, r.conversion_rate_pct, r.avg_time_sec)
        for r in allp.filter(F.col("dimension") == "device_type").collect()
    }
    ref = {
        (r.device_type, r.test_group): (r.sessions, r.conversion_rate_pct, r.avg_time_sec)
        for r in ss.device_profile(c).collect()
    }
    assert got == ref
    hours = {(r.value, r.test_group): r.sessions for r in allp.filter(F.col("dimension") == "hour_of_day").collect()}
    ref_h = {(str(r.hour_of_day), r.test_group): r.sessions for r in ss.hourly_trend(c).collect()}
    assert hours == ref_h


def test_run_report_materializes_once(spark, tmp_path):
    sessions = ss.load_test_sessions(spark, SF001)
    out = str(tmp_path / "report")
    res = plans.run_report(spark, sessions, out_dir=out, names=["group_summary", "kpi_lift", "daily_trend"])
    direct = ss.group_summary(ss.clean(sessions)).collect()
    assert sorted(res["group_summary"].collect()) == sorted(direct)
    assert res["kpi_lift"].count() == 6
    c = plans.prepared_clean(sessions)
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert "events" not in plan  # lineage cut: reads the written table, not the source


def test_streaming_totals_match_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    sessions = ss.load_test_sessions(spark, SF001)
    ss.write_sessions(sessions.repartition(4), src)
    stream = stream_sessions(spark, src, max_files_per_trigger=1)
    q = (
        live_arm_totals(stream)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("arm_totals")
        .option("checkpointLocation", str(tmp_path / "ckpt1"))
        .start()
    )
    q.processAllAvailable()
    q.stop()
    live = {r.test_group: (r.sessions, r.conversions) for r in spark.table("arm_totals").collect()}
    batch = {r.test_group: (r.total_sessions, r.conversions) for r in ss.group_summary(ss.clean(sessions)).collect()}
    assert live == batch
    z_live = ztest_from_totals(spark.table("arm_totals")).first().z_statistic
    assert z_live == ss.ztest(ss.clean(sessions)).first().z_statistic

    q2 = (
        live_daily_trend(stream_sessions(spark, src), watermark="1 day")
        .writeStream.outputMode("append")
        .format("memory")
        .queryName("daily_live")
        .option("checkpointLocation", str(tmp_path / "ckpt2"))
        .start()
    )
    q2.processAllAvailable()
    q2.stop()
    emitted = {(r.session_date, r.test_group): r.sessions for r in spark.table("daily_live").collect()}
    batch_days = {
        (r.session_date, r.test_group): r.sessions for r in ss.daily_trend(ss.clean(sessions), min_sessions=0).collect()
    }
    # every finalized day equals the batch count; only days behind the watermark are emitted
    assert emitted and all(batch_days[k] == v for k, v in emitted.items())


def test_report_cli(spark, tmp_path, capsys):
    from splitscope.__main__ import main

    src = str(tmp_path / "sessions")
    ss.write_sessions(ss.load_test_sessions(spark, SF001), src)
    out = str(tmp_path / "out")
    main(["--sessions", src, "--out", out, "--only", "group_summary", "kpi_lift"])
    printed = capsys.readouterr().out
    assert "== group_summary" in printed and "== kpi_lift" in printed
    assert spark.read.parquet(f"{out}/kpi_lift").count() == 6


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    from splitscope.streaming import start

    src = str(tmp_path / "in")
    sessions = ss.load_test_sessions(spark, SF001)
    half = sessions.filter(F.col("session_id").cast("bigint") % 2 == 0)
    rest = sessions.filter(F.col("session_id").cast("bigint") % 2 == 1)
    half.write.parquet(f"{src}/part=1")
    import uuid

    name = f"arm_totals_{uuid.uuid4().hex[:10]}"  # a fresh stream: its checkpoint must not exist yet
    q = start(live_arm_totals(stream_sessions(spark, src)), name, "complete", sink="memory")
    q.processAllAvailable()
    q.stop()
    rest.write.parquet(f"{src}/part=2")  # more files arrive while the query is down
    q = start(live_arm_totals(stream_sessions(spark, src)), name, "complete", sink="memory")
    q.processAllAvailable()
    q.stop()
    live = {r.test_group: r.sessions for r in spark.table(name).collect()}
    batch = {r.test_group: r.total_sessions for r in ss.group_summary(ss.clean(sessions)).collect()}
    assert live == batch  # state restored from the checkpoint, new files counted once


def test_sql_dialect_features_on_views(spark):
    plans.register_views(spark, ss.load_test_sessions(spark, SF01))
    c = ss.clean(ss.load_test_sessions(spark, SF01))
    med = {
        r.test_group: (r.m, r.p90)
        for r in spark.sql(
            """
            SELECT test_group,
                   ROUND(MEDIAN(time_on_dashboard_clean), 2) AS m,
                   ROUND(PERCENTILE_CONT(0.90) WITHIN GROUP (ORDER BY page_load_time_clean), 2) AS p90
            FROM vw_dashboard_clean WHERE data_quality = 'Normal' GROUP BY test_group
            """
        ).collect()
    }
    ours = {r.test_group: r.median_time_on_dashboard for r in ss.group_summary(c).collect()}
    p90 = {r.test_group: r.p90 for r in ss.distribution(c).filter("metric = 'Page Load Time'").collect()}
    assert {k: float(v[0]) for k, v in med.items()} == ours
    assert {k: float(v[1]) for k, v in med.items()} == p90
    banner = spark.sql("SELECT 'status line' AS status FROM dual UNION ALL SELECT 'second' FROM dual").collect()
    assert [r.status for r in banner] == ["status line", "second"]


def test_streaming_approximate_users_and_medians(spark, tmp_path):
    src = str(tmp_path / "in")
    sessions = ss.load_test_sessions(spark, SF01)
    ss.write_sessions(sessions.repartition(3), src)
    q = (
        live_arm_totals(stream_sessions(spark, src, max_files_per_trigger=1), approx=True)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("approx_totals")
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .start()
    )
    q.processAllAvailable()
    q.stop()
    live = {r.test_group: r for r in spark.table("approx_totals").collect()}
    exact = {r.test_group: r for r in ss.group_summary(ss.clean(sessions)).collect()}
    for g, r in exact.items():
        assert abs(live[g].users_approx - r.unique_users) <= max(2, 0.03 * r.unique_users)
        assert abs(live[g].median_time_approx - r.median_time_on_dashboard) <= 0.02 * r.median_time_on_dashboard + 1
        assert live[g].sessions == r.total_sessions


def test_full_report_runs_on_the_materialized_table(spark, tmp_path):
    sessions = ss.load_test_sessions(spark, SF001)
    out = str(tmp_path / "full")
    res = plans.run_report(spark, sessions, out_dir=out)
    assert set(res) == set(plans.analyses())
    direct = ss.clean(sessions)
    # spot checks against the analyses on the unmaterialized view
    assert sorted(res["daily_trend"].collect()) == sorted(ss.daily_trend(direct).collect())
    assert sorted(res["ztest_conversion"].collect()) == sorted(ss.ztest(direct).collect())
    months = {r.value for r in res["profiles"].filter("dimension = 'year_month'").collect()}
    assert months == {r.year_month for r in direct.select("year_month").distinct().collect()}
