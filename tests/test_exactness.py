"""Results on rows the fixture lacks: NULL outcomes and keys, empty cells, repeated sessions, permuted files."""

import datetime as dt
import math

import pytest
from conftest import SF001
from pyspark.sql import functions as F

import splitscope as ss
from splitscope import plans

T0 = dt.datetime(2024, 1, 1)


def _clean(spark, rows):
    """rows: (session_id, user_id, minutes or None, arm, device, conversion)."""
    full = [(s, u, None if m is None else T0 + dt.timedelta(minutes=m), a, d, "US", "new_user", 1.0, 1, 1, 10.0, 0, y) for s, u, m, a, d, y in rows]
    schema = ", ".join(f"{f.name} {'double' if 'sec' in f.name else f.dataType.simpleString()}" for f in ss.SESSION_SCHEMA.fields)
    return ss.clean(spark.createDataFrame(full, schema))


def _arm_rows(a, b):
    """Sessions with a = (n, x) in arm A and b = (n, x) in arm B."""
    out = []
    for arm, (n, x) in (("A", a), ("B", b)):
        out += [(f"{arm}{i}", f"{arm}{i}", i, arm, "mobile" if i % 2 else "desktop", int(i < x)) for i in range(n)]
    return out


@pytest.mark.parametrize("a, b", [((10, 0), (10, 5)), ((10, 5), (10, 0)), ((7, 2), (13, 9)), ((10, 10), (10, 3))])
def test_chi_square_is_the_square_of_z(spark, a, b):
    c = _clean(spark, _arm_rows(a, b))
    z, chi = ss.ztest(c).first(), ss.chi2_outcome(c).first()
    assert math.isclose(chi.chi_square_statistic, z.z_statistic**2, rel_tol=2e-4)
    assert abs(chi.p_value - z.p_value_two_sided) < 2e-6 and chi.degrees_of_freedom == 1


def test_empty_cell_value(spark):
    chi = ss.chi2_outcome(_clean(spark, _arm_rows((10, 0), (10, 5)))).first()
    assert chi.chi_square_statistic == 6.6667 and chi.p_value == pytest.approx(0.0098, abs=1e-4)
    one_outcome = ss.chi2_outcome(_clean(spark, _arm_rows((4, 0), (5, 0)))).first()
    assert one_outcome.chi_square_statistic is None and one_outcome.conclusion.startswith("NOT")


def test_unknown_outcomes_count_nowhere(spark):
    rows = _arm_rows((12, 4), (12, 7))
    known = _clean(spark, rows)
    mixed = _clean(spark, rows + [(f"n{i}", f"n{i}", i, "AB"[i % 2], "mobile", None) for i in range(10)])
    for f in (ss.ztest, ss.chi2_outcome, ss.stratified_test, ss.simpson_check, ss.interaction, ss.power_analysis, ss.sensitivity, ss.roi, ss.recommend):
        assert f(known).collect() == f(mixed).collect(), f.__name__
    rate = {r.test_group: r.conversion_rate_pct for r in ss.group_summary(mixed).collect()}
    z = ss.ztest(mixed).first()
    assert (round(z.rate_a_pct, 2), round(z.rate_b_pct, 2)) == (rate["A"], rate["B"])


def test_correlations_use_pairs(spark):
    c = _clean(spark, _arm_rows((9, 4), (9, 5)))
    w = F.when(F.col("user_id") != "A3", F.col("session_timestamp").cast("string").substr(15, 2).cast("int") % 5)
    holed = c.withColumn("widgets_viewed", w).withColumn("conversion", F.when(F.col("user_id") != "B2", F.col("conversion")))
    got = {r.test_group: r.correlation for r in ss.correlations(holed, features=("widgets_viewed",)).collect()}
    pairs = holed.filter("widgets_viewed IS NOT NULL AND conversion IS NOT NULL")
    want = {r.test_group: r.r for r in pairs.groupBy(F.col("group_id").alias("test_group")).agg(F.corr("widgets_viewed", "conversion").alias("r")).collect()}
    want["All"] = pairs.agg(F.corr("widgets_viewed", "conversion")).first()[0]
    assert got == {k: round(v, 4) for k, v in want.items()}


def test_first_conversion_on_repeated_sessions_and_nulls(spark):
    rows = [
        ("s1", "u", 1, "A", "mobile", 0), ("s2", "u", 2, "A", "mobile", 1), ("s2", "u", 2, "A", "mobile", 1), ("s3", "u", 3, "B", "mobile", 1),
        ("t1", "v", None, "A", "mobile", 1), ("t2", "v", 5, "A", "mobile", 1),
        ("w1", None, 1, "A", "mobile", 0), ("w2", None, 2, "A", "mobile", 1),
        ("x1", "x", 1, "A", "mobile", 1), ("x1", "x", 1, "A", "mobile", 1), (None, "y", 1, "A", "mobile", 0), ("y1", "y", 1, "A", "mobile", 1),
    ]
    c = _clean(spark, rows)
    results = [sorted(map(str, ss.first_conversion(c, m).collect())) for m in ("window", "join", "salted")]
    assert results[0] == results[1] == results[2] and len(results[0]) == 6


def test_csv_header_is_checked(spark, tmp_path):
    from splitscope.sources.sessions import CSV_COLUMNS

    values = {"user_id": "u1", "session_id": "s1", "timestamp": "2024-01-02 03:04:05", "group": "A", "device_type": "mobile", "country": "US",
              "cookie_segment": "new_user", "page_load_time_sec": "1.25", "widgets_viewed": "2", "filters_applied": "1",
              "time_on_dashboard_sec": "30.50", "bounce": "0", "conversion": "1"}
    swapped = ["session_id", "user_id", *CSV_COLUMNS[2:]]
    for name, header in (("good", list(CSV_COLUMNS)), ("bad", swapped)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.csv").write_text(",".join(header) + "\n" + ",".join(values[h] for h in header) + "\n")
    row = ss.read_sessions_csv(spark, str(tmp_path / "good")).first()
    assert (row.session_id, row.user_id, row.group_id) == ("s1", "u1", "A")
    with pytest.raises(Exception, match="header"):
        ss.read_sessions_csv(spark, str(tmp_path / "bad")).collect()

    from splitscope.streaming import stream_sessions

    def run(folder):
        out, rows = stream_sessions(spark, str(tmp_path / folder), "csv"), []
        q = out.writeStream.foreachBatch(lambda d, _: rows.extend(d.collect())).option("checkpointLocation", str(tmp_path / f"ck-{folder}")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return rows

    assert [(r.session_id, r.user_id) for r in run("good")] == [("s1", "u1")]
    with pytest.raises(Exception):  # noqa: B017  (the stream's failure carries the reader's)
        run("bad")


def test_logit_null_level_separation_and_convergence(spark):
    rows = _arm_rows((40, 12), (40, 21)) + [(f"z{i}", f"z{i}", i, "AB"[i % 2], None, i % 3 == 0) for i in range(30)]
    rows += [(f"q{i}", f"q{i}", i, "AB"[i % 2], "tablet", 0) for i in range(12)]
    got = {r.term: r for r in ss.logit_model(_clean(spark, [(*r[:5], int(r[5])) for r in rows]), covariates=("device_type",), max_iter=15).collect()}
    assert set(got) == {"treatment_B", "device_type=mobile", "device_type=tablet", "device_type=NULL", "intercept"}
    assert got["device_type=tablet"].separated and not got["treatment_B"].separated and not got["device_type=NULL"].separated
    assert not got["treatment_B"].converged  # the separated level never settles
    settled = ss.logit_model(ss.clean(ss.load_test_sessions(spark, SF001)))
    assert all(r.converged for r in settled.collect())


def test_logit_takes_any_number_of_levels(spark):
    rows = [(f"s{i}", f"u{i}", i, "AB"[i % 2], f"d{i % 60:03d}", int(i % 7 < 2 + i % 2)) for i in range(1500)]
    assert ss.logit_model(_clean(spark, rows), covariates=("device_type",)).count() == 61


def test_profiles_keep_the_dimension_of_null_values(spark):
    c = _clean(spark, _arm_rows((4, 1), (4, 2)) + [("n", "n", 1, "A", None, 1)])
    rows = plans.profiles(c, dims=("device_type", "country")).collect()
    assert all(r.dimension is not None for r in rows)
    assert [(r.dimension, r.sessions) for r in rows if r.value is None] == [("device_type", 1)]


def test_plans_of_tests_stay_small(spark):
    c = ss.clean(ss.load_test_sessions(spark, SF001))
    simple = len(ss.simpson_check(c)._jdf.queryExecution().optimizedPlan().toString())
    for f in (ss.stratified_test, ss.metric_comparison, ss.ztest):
        assert len(f(c)._jdf.queryExecution().optimizedPlan().toString()) < 6 * simple, f.__name__


def test_checkpoint_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from splitscope import session

    class Context:
        master = "local-cluster[2,1,1024]"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_break_even_days_and_balance(spark):
    c = ss.clean(ss.load_test_sessions(spark, SF001))
    for r in ss.roi(c).collect():
        if r.break_even_days is not None:
            daily = ss.DEFAULT_ROI.monthly_sessions * 12 / 365 * r.pct_of_sessions / 100
            assert r.break_even_days == pytest.approx(r.break_even_sessions / daily, abs=0.02)
    checks = lambda n, m: {r["check"]: r["value"] for r in ss.quality_checks(_clean(spark, _arm_rows((n, 1), (m, 1))).select("session_id", "group_id")).collect()}
    assert checks(50, 51)["arms_balanced"] == 1.0 and checks(50, 60)["arms_balanced"] == 0.0
