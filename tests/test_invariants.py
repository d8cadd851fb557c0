"""Property tests on random session frames (hypothesis) and cross-checks of the
statistics against independent computations."""

import datetime as dt
import math
from decimal import Decimal

from helpers import BASE_TS, sessions
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import splitscope as ss

SEGS = ["new_user", "returning_low", "returning_med", "returning_high", "anonymous"]
DEVS = ["desktop", "mobile", "tablet"]

session_row = st.tuples(
    st.integers(0, 12),  # user
    st.sampled_from(["A", "B"]),
    st.sampled_from(DEVS),
    st.sampled_from(SEGS),
    st.integers(-50, 1200),  # load * 100
    st.integers(-500, 70000),  # time * 100
    st.integers(0, 9),
    st.integers(0, 5),
    st.integers(0, 1),
    st.integers(0, 1),
    st.integers(0, 500),  # minutes offset
)


def _frame(spark, rows):
    out = []
    for i, (u, arm, dev, seg, load, time, w, f, b, c, m) in enumerate(rows):
        out.append(
            (f"s{i}", f"u{u}", BASE_TS + dt.timedelta(minutes=m), arm, dev, "US", seg,
             Decimal(load) / 100, w, f, Decimal(time) / 100, b, c)
        )
    return ss.clean(sessions(spark, out))


SETTINGS = settings(max_examples=4, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(session_row, min_size=4, max_size=40))
def test_shares_and_counts(spark, rows):
    c = _frame(spark, rows)
    q = ss.quality_breakdown(c).collect()
    assert sum(r.record_count for r in q) == len(rows)
    assert abs(sum(r.percentage for r in q) - 100) <= 0.01 * len(q)
    for r in ss.balance(c, "device_type").groupBy("device_type").sum("pct_within_device_type").collect():
        assert abs(r[1] - 100) <= 0.02
    cont = ss.contingency(c).collect()
    assert sum(r.observed for r in cont) == len(rows)
    # expected counts exist for observed cells only (GROUP BY semantics): they add up
    # to the total exactly when every segment x arm cell is present
    full = len(cont) == len({r.cookie_segment for r in cont}) * len({r.group_id for r in cont})
    total_expected = sum(r.expected for r in cont)
    if full:
        assert math.isclose(total_expected, len(rows), rel_tol=1e-9)
    else:
        assert total_expected < len(rows) + 1e-9


@SETTINGS
@given(st.lists(session_row, min_size=4, max_size=40))
def test_converters_and_percentiles(spark, rows):
    c = _frame(spark, rows)
    users = {r.test_group: r.users_who_converted for r in ss.user_summary(c).collect()}
    s2c = {}
    for r in ss.sessions_to_conversion(c).collect():
        s2c[r.test_group] = s2c.get(r.test_group, 0) + r.users
    assert {k: v for k, v in users.items() if v} == s2c
    for r in ss.distribution(c).collect():
        qs = [r.p10, r.p25, r.p50_median, r.p75, r.p90, r.p95]
        assert qs == sorted(qs)


def test_z_squared_equals_chi_square(spark):
    c = ss.clean(ss.load_test_sessions(spark, "/root/testdata/sf0.01"))
    z = ss.ztest(c).first().z_statistic
    chi = ss.chi2_outcome(c).first().chi_square_statistic
    assert math.isclose(z * z, chi, rel_tol=1e-3)


def test_randomization_chi2_matches_mllib(spark):
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    c = ss.clean(ss.load_test_sessions(spark, "/root/testdata/sf0.01"))
    ours = ss.randomization_test(c).first()
    idx = StringIndexer(inputCols=["cookie_segment", "group_id"], outputCols=["seg_i", "arm_i"]).fit(c).transform(c)
    vec = VectorAssembler(inputCols=["seg_i"], outputCol="f").transform(idx)
    r = ChiSquareTest.test(vec, "f", "arm_i").first()
    assert math.isclose(float(r.statistics[0]), ours.chi_square_statistic, abs_tol=1e-4)
    assert r.degreesOfFreedom[0] == ours.degrees_of_freedom
    assert math.isclose(float(r.pValues[0]), ours.p_value, abs_tol=1e-6)


def test_interaction_closed_form_equals_glm(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    from pyspark.sql import functions as F

    c = ss.clean(ss.load_test_sessions(spark, "/root/testdata/sf0.01"))
    closed = {r.device_type: r.interaction for r in ss.interaction(c).collect()}
    n = ss.normal(c)
    cells = n.groupBy("test_group", "device_type").agg(F.count("*").alias("n"), F.sum("conversion").alias("x"))
    b = (F.col("test_group") == "B").cast("double")
    design = cells.select(
        b.alias("b"),
        (F.col("device_type") == "mobile").cast("double").alias("m"),
        (F.col("device_type") == "tablet").cast("double").alias("t"),
        (b * (F.col("device_type") == "mobile").cast("double")).alias("bm"),
        (b * (F.col("device_type") == "tablet").cast("double")).alias("bt"),
        (F.col("x") / F.col("n")).alias("rate"),
        F.col("n").cast("double").alias("w"),
    )
    data = VectorAssembler(inputCols=["b", "m", "t", "bm", "bt"], outputCol="features").transform(design)
    glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="rate", weightCol="w").fit(data)
    assert math.isclose(glm.coefficients[3], closed["mobile"], abs_tol=1e-5)
    assert math.isclose(glm.coefficients[4], closed["tablet"], abs_tol=1e-5)


def test_logit_treatment_only_equals_log_odds_ratio(spark):
    c = ss.clean(ss.load_test_sessions(spark, "/root/testdata/sf0.01"))
    coef = {r.term: r.coefficient for r in ss.logit_model(c, covariates=()).collect()}
    z = ss.ztest(c).first()
    pa, pb = z.successes_a / z.n_a, z.successes_b / z.n_b
    lor = math.log(pb / (1 - pb)) - math.log(pa / (1 - pa))
    assert math.isclose(coef["treatment_B"], lor, abs_tol=1e-5)


def test_chi2_tail_closed_form(spark):
    from pyspark.sql import functions as F

    from splitscope.functions import chi2_critical_col, chi2_sf

    rows = [(x, k) for k in (1, 2, 3, 4, 5, 7, 10) for x in (0.5, 3.0, 9.488, 20.0)]
    df = spark.createDataFrame(rows, "x double, k int").select("x", "k", chi2_sf(F.col("x"), F.col("k")).alias("p"))
    for r in df.collect():
        # survival at the critical value of alpha equals alpha
        crit = spark.range(1).select(chi2_critical_col(F.lit(r.k), 0.05).alias("c")).first().c
        p_at = spark.range(1).select(chi2_sf(F.lit(crit), F.lit(r.k)).alias("p")).first().p
        assert math.isclose(p_at, 0.05, abs_tol=1e-4)  # the value has three decimals
        assert 0.0 <= r.p <= 1.0


@settings(max_examples=6, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.sampled_from(["A", "B"]), st.one_of(st.none(), st.integers(-3, 12))), min_size=1, max_size=80),
    st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]), min_size=1, max_size=4),
)
def test_histogram_percentiles_equal_spark_percentile(spark, rows, probs):
    from pyspark.sql import functions as F

    from splitscope.operators.distribution import exact_percentiles

    df = spark.createDataFrame(rows, "g string, v int")
    ours = {
        r.g: [round(x, 9) for x in r.q]
        for r in exact_percentiles(df, ["g"], [("v", "v")], probs).collect()
    }
    ref = {
        r.g: [round(x, 9) for x in r.q]
        for r in df.groupBy("g")
        .agg(F.expr(f"percentile(v, array({', '.join(map(str, probs))}))").alias("q"))
        .collect()
        if r.q is not None
    }
    assert ours == ref


def test_logit_on_cells_equals_per_session_fit(spark):
    """The grouped-binomial fit on covariate cells equals the fit on individual sessions."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    from pyspark.sql import functions as F

    c = ss.clean(ss.load_test_sessions(spark, "/root/testdata/sf0.01"))
    ours = {r.term: (r.coefficient, r.std_error) for r in ss.logit_model(c, covariates=("device_type",)).collect()}
    n = ss.normal(c)
    rows = n.select(
        (F.col("test_group") == "B").cast("double").alias("b"),
        (F.col("device_type") == "mobile").cast("double").alias("m"),
        (F.col("device_type") == "tablet").cast("double").alias("t"),
        F.col("conversion").cast("double").alias("y"),
    )
    data = VectorAssembler(inputCols=["b", "m", "t"], outputCol="features").transform(rows)
    fit = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="y").fit(data)
    se = list(fit.summary.coefficientStandardErrors)
    for i, term in enumerate(["treatment_B", "device_type=mobile", "device_type=tablet"]):
        assert math.isclose(ours[term][0], fit.coefficients[i], abs_tol=2e-6)
        assert math.isclose(ours[term][1], se[i], abs_tol=2e-6)
    assert math.isclose(ours["intercept"][0], fit.intercept, abs_tol=2e-6)


def test_reports_agree_with_each_other(spark):
    c = ss.clean(ss.load_test_sessions(spark, "/root/testdata/sf0.01"))
    summary = {r.test_group: r for r in ss.group_summary(c).collect()}
    lift = {r.metric: r for r in ss.kpi_lift(c).collect()}
    assert lift["Conversion Rate"].group_a_value == summary["A"].conversion_rate_pct
    assert lift["Avg Time on Dashboard"].group_b_value == summary["B"].avg_time_on_dashboard
    funnel = {r.test_group: r for r in ss.funnel(c).collect()}
    assert all(funnel[g].total_sessions == summary[g].total_sessions for g in summary)
    assert all(funnel[g].converted == summary[g].conversions for g in summary)
    z = ss.ztest(c).first()
    assert (z.n_a, z.successes_a) == (summary["A"].total_sessions, summary["A"].conversions)
    prep = ss.prep_summary(c).first()
    assert prep.total_sessions == sum(r.total_sessions for r in summary.values())
    segs = ss.segment_profile(c).collect()
    assert sum(r.sessions for r in segs) == prep.total_sessions


@settings(max_examples=6, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(st.integers(0, 4), st.sampled_from(["A", "B"]), st.integers(0, 6), st.integers(0, 1)),
        min_size=1,
        max_size=60,
    )
)
def test_first_conversion_join_equals_row_number(spark, rows):
    # few users, few distinct minutes: many timestamp ties and cross-arm users
    out = []
    for i, (u, arm, minute, conv) in enumerate(rows):
        out.append(
            (f"s{i:03d}", f"u{u}", BASE_TS + dt.timedelta(minutes=minute), arm, "desktop", "US", "new_user",
             Decimal("1.00"), 1, 1, Decimal("10.00"), 0, conv)
        )
    c = ss.clean(sessions(spark, out))
    ref = sorted(ss.first_conversion(c, "window").collect())
    assert sorted(ss.first_conversion(c, "join").collect()) == ref
    assert sorted(ss.first_conversion(c, "salted", salt_buckets=3).collect()) == ref


def test_percentiles_of_a_metric_with_very_many_values(spark):
    """10^5 distinct doubles, heavily skewed, with negative, repeated and NULL values and a NULL key."""
    from pyspark.sql import functions as F

    from splitscope.operators.distribution import exact_percentiles

    u = (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) + 1) / F.lit(1_000_004.0)
    x = F.exp(-F.log(u) * 3) * F.when(F.col("id") % 5 == 0, -1.0).otherwise(1.0)
    x = F.when(F.col("id") % 7 == 0, 1.5).when(F.col("id") % 1009 == 0, None).otherwise(x)
    arm = F.when(F.col("id") % 3 == 0, "A").when(F.col("id") % 3 == 1, "B")
    df = spark.range(150_000).select(arm.alias("arm"), x.alias("x"), (F.col("id") % 2).alias("y"))
    assert df.select("x").distinct().count() > 100_000
    probs = [0.0, 0.001, 0.1, 0.25, 0.5, 0.75, 0.95, 0.9999, 1.0]
    want = {r.arm: r for r in df.groupBy("arm").agg(F.percentile("x", probs).alias("x"), F.percentile("y", probs).alias("y"), F.avg("x").alias("m"), F.count("x").alias("n")).collect()}
    for ranges in (64, 3):
        got = exact_percentiles(df, ["arm"], [("x", "x"), ("y", "y")], probs, ranges).collect()
        assert len(got) == 6
        for r in got:
            assert [round(v, 9) for v in r.q] == [round(v, 9) for v in want[r.arm][r.metric]], r
            assert r.metric == "y" or (r.n == want[r.arm].n and abs(r.mean / want[r.arm].m - 1) < 1e-9)
    assert exact_percentiles(df.limit(0), ["arm"], [("x", "x")], probs).count() == 0
