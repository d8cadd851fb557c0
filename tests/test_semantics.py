"""Edge semantics of the reports: one-row groups, missing arms, NULL lift order,
cross-arm numbering, tiebreaks, day rounding, funnel ratios above 100."""

import datetime as dt

from helpers import BASE_TS, row, sessions

import splitscope as ss


def test_one_row_arm_has_zero_stddev(spark):
    rows = [row("s1", uid="u1", arm="A", conversion=1), row("s2", uid="u2", arm="B"), row("s3", uid="u3", arm="B", conversion=1)]
    out = {r.test_group: r for r in ss.group_summary(ss.clean(sessions(spark, rows))).collect()}
    assert out["A"].conversion_stddev == 0.0
    assert out["B"].conversion_stddev == 0.7071


def test_missing_arm_gives_no_lift_rows(spark):
    rows = [row("s1", uid="u1", arm="A", conversion=1), row("s2", uid="u2", arm="A")]
    c = ss.clean(sessions(spark, rows))
    assert ss.kpi_lift(c).count() == 0
    assert ss.ztest(c).count() == 0


def test_segment_lift_drops_one_arm_segment_and_sorts_null_first(spark):
    rows = [
        # seg1: A rate 0 -> relative lift NULL, must sort first (DESC NULLS FIRST)
        row("s1", uid="u1", arm="A", segment="seg1"),
        row("s2", uid="u2", arm="B", segment="seg1", conversion=1),
        # seg2: both arms, positive lift
        row("s3", uid="u3", arm="A", segment="seg2", conversion=1),
        row("s4", uid="u4", arm="A", segment="seg2"),
        row("s5", uid="u5", arm="B", segment="seg2", conversion=1),
        # seg3: only arm B -> dropped
        row("s6", uid="u6", arm="B", segment="seg3", conversion=1),
    ]
    out = ss.segment_lift(ss.clean(sessions(spark, rows))).collect()
    assert [r.cookie_segment for r in out] == ["seg1", "seg2"]
    assert out[0].relative_lift_pct is None
    assert out[1].relative_lift_pct == 100.0


def test_first_conversion_numbers_across_arms_with_id_tiebreak(spark):
    t0 = BASE_TS
    rows = [
        row("s1", uid="u1", arm="A", ts=t0),
        row("s3", uid="u1", arm="B", ts=t0 + dt.timedelta(hours=1)),
        row("s2", uid="u1", arm="B", ts=t0 + dt.timedelta(hours=1), conversion=1),  # same ts, smaller id first
        row("s4", uid="u1", arm="A", ts=t0 + dt.timedelta(hours=2), conversion=1),
        row("s5", uid="u2", arm="A", ts=t0, conversion=1),
    ]
    c = ss.clean(sessions(spark, rows))
    for method in ("join", "window"):
        got = {(r.user_id, r.test_group): r.session_of_first_conversion for r in ss.first_conversion(c, method).collect()}
        assert got == {("u1", "B"): 2, ("u1", "A"): 4, ("u2", "A"): 1}, method


def test_days_of_data_rounds_fractional_days(spark):
    t0 = BASE_TS
    rows = [row("s1", uid="u1", ts=t0), row("s2", uid="u2", ts=t0 + dt.timedelta(days=2, hours=13))]
    r = ss.prep_summary(ss.clean(sessions(spark, rows))).first()
    assert r.days_of_data == 3.0
    assert r.total_sessions == 2 and r.unique_users == 2


def test_funnel_ratio_can_exceed_100(spark):
    # no session viewed a widget, two applied filters: filter/widget ratio undefined (NULL),
    # and conversions exceed filter users -> ratio above 100
    rows = [
        row("s1", uid="u1", widgets=0, filters=1, conversion=1),
        row("s2", uid="u2", widgets=0, filters=0, conversion=1),
        row("s3", uid="u3", widgets=2, filters=0, conversion=1),
    ]
    r = ss.funnel(ss.clean(sessions(spark, rows))).first()
    assert (r.no_bounce, r.viewed_widgets, r.applied_filters, r.converted) == (3, 1, 1, 3)
    assert r.pct_convert_of_filter == 300.0
    strict = ss.funnel(ss.clean(sessions(spark, rows)), strict=True).first()
    assert (strict.viewed_widgets, strict.applied_filters, strict.converted) == (1, 0, 0)
    assert strict.pct_convert_of_filter is None


def test_weekday_trend_is_monday_first(spark):
    rows = [row(f"s{i}", uid=f"u{i}", ts=BASE_TS + dt.timedelta(days=6 - i)) for i in range(7)]
    out = [r.day_of_week for r in ss.weekday_trend(ss.clean(sessions(spark, rows))).collect()]
    assert out == ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def test_quality_checks_counts_nulls_and_duplicates(spark):
    rows = [row("s1", uid="u1", load=None), row("s1", uid="u2", arm="B"), row("s2", uid="u3", time=None)]
    out = {r.check: r.value for r in ss.quality_checks(sessions(spark, rows)).collect()}
    assert out["rows"] == 3 and out["duplicate_session_ids"] == 1
    assert out["null_page_load_time_sec"] == 1 and out["null_time_on_dashboard_sec"] == 1
    assert out["sessions_A"] == 2 and out["pct_B"] == 33.33


def test_group_summary_approx_users_close_to_exact(spark):
    from conftest import SF01

    c = ss.clean(ss.load_test_sessions(spark, SF01))
    exact = {r.test_group: r.unique_users for r in ss.group_summary(c).collect()}
    approx = {r.test_group: r.unique_users for r in ss.group_summary(c, approx_users=0.01).collect()}
    assert all(abs(approx[k] - exact[k]) <= max(2, 0.05 * exact[k]) for k in exact)


def test_degenerate_inputs_do_not_fail_under_ansi(spark):
    # an arm without conversions (constant outcome) and a frame with no Normal rows
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    rows = [row(f"s{i}", uid=f"u{i % 3}", arm="A" if i % 2 else "B", widgets=i % 4, conversion=0) for i in range(12)]
    c = ss.clean(sessions(spark, rows))
    corr = ss.correlations(c).collect()
    assert all(r.correlation is None for r in corr)
    for op in (ss.findings, ss.metric_comparison, ss.ztest, ss.sensitivity, ss.power_analysis, ss.interaction):
        op(c).collect()
    none_normal = ss.clean(sessions(spark, [row("s1", load="-1.00"), row("s2", load="11.00", arm="B")]))
    prep = ss.prep_summary(none_normal).first()
    assert prep.total_sessions == 0 and prep.avg_sessions_per_user is None
    assert ss.group_summary(none_normal).count() == 0
    ss.findings(none_normal).collect()


def test_logit_on_tiny_inputs_runs(spark):
    # saturated or nearly empty designs: the fit runs; inference may be unavailable (NULL)
    for rows in (
        [row("s1", uid="u1", arm="A", conversion=1), row("s2", uid="u2", arm="B", conversion=0)],
        [row("s1", uid="u1", arm="A", device="mobile"), row("s2", uid="u2", arm="B", device="desktop", conversion=1)],
    ):
        out = ss.logit_model(ss.clean(sessions(spark, rows)), covariates=("device_type",)).collect()
        assert "treatment_B" in {r.term for r in out}
