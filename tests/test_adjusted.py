"""Regression on odd tables, joint interaction, stratum-adjusted effect, user-clustered errors, chain attribution."""

import math
import random

import numpy as np
import pytest
from conftest import SF01
from helpers import row, sessions
from pyspark.sql import functions as F

import __spark_entry__ as entry
import splitscope as ss
from splitscope.operators import journey, model
from splitscope.plans import inspect as pi


def _clean(spark, rows):
    return ss.clean(sessions(spark, rows))


def _rows(counts, **more):
    """Sessions of (arm, device, segment, n, x) cells, each with x conversions."""
    out = []
    for arm, device, segment, n, x in counts:
        out += [row(f"{len(out) + i}", f"u{len(out) + i}", arm, device=device, segment=segment, conversion=int(i < x), **more) for i in range(n)]
    return out


def _table(df):
    return {r.term: r for r in df.collect()}


# ------------------------------------------------------------------ regression


def test_models_on_tables_without_an_answer(spark):
    """Empty, NULL arm only, one arm, outliers only, NULL metrics: defined rows without figures, never an error."""
    known = _rows([("A", "desktop", "new_user", 20, 5)])
    cases = {
        "empty": [],
        "null arm": [row(i, arm=None) for i in range(4)],
        "third arm": [row(i, arm="C") for i in range(4)],
        "one arm": known,
        "one row of NULL metrics": [row(1, load=None, time=None, widgets=None, filters=None, conversion=None)],
        "outliers": [row(i, arm="AB"[i % 2], load="99.00", conversion=i % 2) for i in range(6)],
        "constant outcome": _rows([("A", "desktop", "new_user", 9, 0), ("B", "desktop", "new_user", 9, 0)]),
    }
    for name, rows in cases.items():
        for fit in (ss.logit_model, ss.firth_model, ss.driver_model):
            got = _table(fit(_clean(spark, rows)))
            assert {"treatment_B", "intercept"} <= set(got), (name, fit)
            if name not in ("constant outcome",):
                assert got["treatment_B"].coefficient is None and got["treatment_B"].p_value is None, (name, fit)
    one = _table(ss.logit_model(_clean(spark, known), covariates=()))
    assert one["intercept"].coefficient == pytest.approx(math.log(5 / 15), abs=1e-6) and one["intercept"].converged


def test_other_arms_leave_the_fit_alone(spark):
    two = _rows([("A", "desktop", "new_user", 40, 10), ("B", "desktop", "new_user", 40, 19)])
    more = two + [row(f"c{i}", arm=arm, conversion=1) for i, arm in enumerate(["C"] * 30 + [None] * 10)]
    for fit in (lambda c: ss.logit_model(c, covariates=()), lambda c: ss.firth_model(c, covariates=()), ss.driver_model):
        assert fit(_clean(spark, two)).collect() == fit(_clean(spark, more)).collect()


def test_collinear_terms_have_no_figures_and_the_others_keep_theirs(spark):
    cells = [("A", "desktop", "new_user", 30, 6), ("B", "desktop", "new_user", 30, 12), ("A", "mobile", "anonymous", 30, 9), ("B", "mobile", "anonymous", 30, 15)]
    c = _clean(spark, _rows(cells))
    both, alone = _table(ss.logit_model(c, covariates=("device_type", "cookie_segment"))), _table(ss.logit_model(c, covariates=("device_type",)))
    assert both["cookie_segment=new_user"].coefficient is None and both["cookie_segment=new_user"].std_error is None
    for term, r in alone.items():
        assert both[term].coefficient == r.coefficient and both[term].std_error == r.std_error
    drivers = _table(ss.driver_model(c))  # one value of widgets, filters and time
    assert drivers["widgets"].coefficient is None and drivers["treatment_B"].coefficient is not None


def test_separation_by_a_combination_of_terms(spark):
    """No term's rows have one outcome only, and yet treatment, device and intercept together part them."""
    cells = [("A", "desktop", "new_user", 20, 0), ("A", "mobile", "new_user", 20, 7), ("B", "desktop", "new_user", 20, 9), ("B", "mobile", "new_user", 20, 20)]
    apart = _table(ss.logit_model(_clean(spark, _rows(cells)), covariates=("device_type",)))
    assert all(r.separated and not r.converged and r.std_error is None for r in apart.values())
    cells[0], cells[3] = ("A", "desktop", "new_user", 20, 1), ("B", "mobile", "new_user", 20, 19)
    mixed = _table(ss.logit_model(_clean(spark, _rows(cells)), covariates=("device_type",)))
    assert not any(r.separated for r in mixed.values()) and all(r.converged for r in mixed.values())
    quasi = [("A", "desktop", "new_user", 20, 0), ("A", "mobile", "new_user", 20, 6), ("B", "mobile", "new_user", 20, 20)]
    apart = _table(ss.logit_model(_clean(spark, _rows(quasi)), covariates=("device_type",)))
    assert apart["treatment_B"].separated and apart["device_type=mobile"].separated and not apart["intercept"].converged
    held = _table(ss.firth_model(_clean(spark, _rows(quasi)), covariates=("device_type",)))
    assert all(abs(r.coefficient) < 10 and r.converged for r in held.values())


def test_firth_equals_half_a_success_and_a_failure_in_a_saturated_table(spark):
    """Jeffreys' prior on a saturated 2 x 2 table adds one half to every cell."""
    got = _table(ss.firth_model(_clean(spark, _rows([("A", "desktop", "x", 12, 0), ("B", "desktop", "x", 15, 15)])), covariates=()))
    a, b = math.log(0.5 / 12.5), math.log(15.5 / 0.5)
    assert got["intercept"].coefficient == pytest.approx(a, abs=1e-6)
    assert got["treatment_B"].coefficient == pytest.approx(b - a, abs=1e-6)


def test_distributed_rounds_equal_local_ones(spark):
    c = ss.clean(ss.load_test_sessions(spark, "/root/testdata/sf0.001"))
    for fit in (ss.driver_model, lambda c, **k: ss.logit_model(c, covariates=("device_type",), **k), lambda c, **k: ss.logit_model(c, covariates=("device_type",), firth=True, **k)):
        assert fit(c, local_cells=0).collect() == fit(c).collect()


def test_terms_that_depend_on_others_are_found_by_pivots():
    x = np.array([[1, 0, 1, 1], [1, 1, 2, 1], [0, 1, 1, 1], [0, 0, 0, 1]], float)
    assert model.independent(x.T @ x, [3, 0, 1, 2]) == [0, 1, 3]
    assert model.independent(np.zeros((2, 2)), [1, 0]) == []


# ------------------------------------------------------------------ joint interaction, adjusted effect


def test_one_effect_everywhere_is_no_interaction(spark):
    same = [("A", "desktop", "s", 100, 20), ("B", "desktop", "s", 100, 50), ("A", "mobile", "s", 200, 40), ("B", "mobile", "s", 200, 100)]
    r = ss.interaction_test(_clean(spark, _rows(same))).first()
    assert r.levels == 2 and r.chi_square_statistic == 0.0 and r.p_value == 1.0 and r.pooled_odds_ratio == 4.0
    other = [*same, ("A", "tablet", "s", 200, 100), ("B", "tablet", "s", 200, 40), ("A", None, "s", 10, 0), ("B", None, "s", 10, 4)]
    r = ss.interaction_test(_clean(spark, _rows(other))).first()
    assert r.levels == 3 and r.levels_without_estimate == 1 and r.degrees_of_freedom == 2 and r.p_value < 1e-6
    one = ss.interaction_test(_clean(spark, _rows(same[:2]))).first()
    assert one.degrees_of_freedom == 0 and one.p_value is None and one.conclusion is None
    assert ss.interaction_test(_clean(spark, [])).count() == 0


def test_a_paradox_is_seen_by_the_adjusted_effect(spark):
    """The treatment is better in both segments and worse in the pooled table."""
    cells = [("A", "d", "easy", 20, 16), ("B", "d", "easy", 200, 170), ("A", "d", "hard", 200, 40), ("B", "d", "hard", 20, 6)]
    flipped = [("A", "d", "easy", 200, 160), ("B", "d", "easy", 20, 17), ("A", "d", "hard", 20, 4), ("B", "d", "hard", 200, 60)]
    r = ss.adjusted_effect(_clean(spark, _rows(flipped))).first()
    assert r.crude_diff_pp < 0 < r.adjusted_diff_pp and r.reversed == "YES" and r.crude_odds_ratio < 1 < r.adjusted_odds_ratio
    # by the textbook sums
    t = [(17, 3, 160, 40), (60, 140, 4, 16)]
    num, den = sum(a * d / (a + b + c + d) for a, b, c, d in t), sum(b * c / (a + b + c + d) for a, b, c, d in t)
    assert r.adjusted_odds_ratio == pytest.approx(num / den, abs=1e-6)
    top = sum(a - (a + b) * (a + c) / (a + b + c + d) for a, b, c, d in t)
    var = sum((a + b) * (c + d) * (a + c) * (b + d) / ((a + b + c + d) ** 2 * (a + b + c + d - 1)) for a, b, c, d in t)
    assert r.cmh_statistic == pytest.approx(top * top / var, abs=1e-4)
    assert r.ci_low < r.adjusted_odds_ratio < r.ci_high
    assert ss.adjusted_effect(_clean(spark, _rows(cells))).first().reversed == "NO"
    assert ss.adjusted_effect(_clean(spark, [])).count() == 0
    assert ss.adjusted_effect(_clean(spark, _rows([("A", "d", "x", 5, 0), ("B", "d", "x", 5, 0)]))).first().p_value is None


# ------------------------------------------------------------------ users


def test_clustered_error_equals_resampling_of_users(spark):
    rng = random.Random(5)
    rows = []
    for u in range(160):
        rate = rng.choice([0.05, 0.6])
        rows += [row(f"{u}-{i}", f"u{u}", "AB"[u % 2], conversion=int(rng.random() < rate)) for i in range(rng.randint(1, 30))]
    got = {r.scenario: r for r in ss.sensitivity(_clean(spark, rows)).collect()}
    clustered, plain = got["user_clustered"], got["normal_only"]
    assert clustered.rate_a_pct == plain.rate_a_pct and clustered.n_b == plain.n_b
    per = {}
    for r in rows:
        n, y = per.get((r[3], r[1]), (0, 0))
        per[r[3], r[1]] = (n + 1, y + r[12])
    users = {arm: np.array([v for (a, _), v in per.items() if a == arm], float) for arm in "AB"}
    gen = np.random.default_rng(1)
    draws = {arm: [(lambda s: s[:, 1].sum() / s[:, 0].sum())(u[gen.integers(0, len(u), len(u))]) for _ in range(4000)] for arm, u in users.items()}
    se = math.sqrt(np.var(draws["A"]) + np.var(draws["B"]))
    diff = users["B"][:, 1].sum() / users["B"][:, 0].sum() - users["A"][:, 1].sum() / users["A"][:, 0].sum()
    assert abs(diff / se / clustered.z_statistic - 1) < 0.06
    assert abs(clustered.z_statistic) < abs(plain.z_statistic)


def test_earliest_rows_equal_the_sorted_ones(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["u", "v", None]), rng.choice([None, 1, 1, 2, 3]), rng.choice([None, "a", "b", "c"]), rng.randint(0, 1), i) for i in range(120)]
    df = spark.createDataFrame(rows, "user_id string, t int, session_id string, hit int, n int")
    df = df.withColumn("session_timestamp", F.timestamp_seconds("t").cast("timestamp_ntz"))
    got = journey.first_rows(df, ["user_id"], {"any": F.lit(True), "hit": F.col("hit") == 1}, ["t", "session_id"]).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "")
    for which, keep in (("any", lambda r: True), ("hit", lambda r: r[3] == 1)):
        want = {u: min((r for r in rows if r[0] == u and keep(r)), key=key)[1:3] for u in ("u", "v", None)}
        assert {r.user_id: tuple(r.row) for r in got if r.which == which} == want


def test_no_sort_based_aggregation_over_sessions(spark):
    """Where strings have to be compared, only the rows left by a join on the least time are sorted."""
    for name in ("sensitivity", "touch_attribution", "first_conversion"):
        for chain in pi.aggregate_inputs(entry._QUERIES[name](spark, SF01), "SortAggregate"):
            assert "Join" in chain or "Aggregate" in chain, (name, chain)


def test_chain_credits_sum_to_the_conversions(spark):
    c = ss.clean(ss.load_test_sessions(spark, SF01))
    got = ss.chain_attribution(c).collect()
    n = ss.normal(c).groupBy("test_group").agg(F.sum("conversion").alias("x"), F.count("*").alias("n")).collect()
    for r in n:
        own = [g for g in got if g.test_group == r.test_group]
        assert sum(g.credited_conversions for g in own) == pytest.approx(r.x, abs=1e-3)
        assert sum(g.touches for g in own) == r.n


def test_transitions_of_hand_made_journeys(spark):
    import datetime as dt

    base = dt.datetime(2025, 3, 3, 9, 59, 59)
    at = lambda i: base + dt.timedelta(minutes=40 * i)
    rows = [
        row(1, "u", "A", ts=at(0), device="x"), row(2, "u", "A", ts=at(0), device="y"), row(3, "u", "A", ts=at(1), device="x", conversion=1),
        row(4, "u", "A", ts=at(3), device="z"), row(5, "v", "A", ts=at(0), device=None, conversion=1), row(6, "u", "B", ts=at(0), device="x"),
    ]
    got = {(r.test_group, r.source, r.target): r.steps for r in journey.touch_transitions(_clean(spark, rows)).collect()}
    assert got == {
        ("A", "<start>", "=x"): 1, ("A", "=x", "=y"): 1, ("A", "=y", "=x"): 1, ("A", "=x", "<conversion>"): 1, ("A", "<start>", "=z"): 1, ("A", "=z", "<exit>"): 1,
        ("A", "<start>", "~"): 1, ("A", "~", "<conversion>"): 1, ("B", "<start>", "=x"): 1, ("B", "=x", "<exit>"): 1,
    }
    credits = {(r.test_group, r.device_type): r for r in ss.chain_attribution(_clean(spark, rows)).collect()}
    assert credits["B", "x"].credited_conversions == 0.0 and credits["B", "x"].removal_effect is None
    assert sum(r.credited_conversions for (g, _), r in credits.items() if g == "A") == pytest.approx(2.0, abs=1e-3)
    assert ss.chain_attribution(_clean(spark, [])).count() == 0


def test_csv_keeps_every_value(spark, tmp_path):
    table = ss.load_test_sessions(spark, "/root/testdata/sf0.001")
    ss.write_sessions_csv(table, str(tmp_path / "s.csv"))
    back = ss.read_sessions_csv(spark, str(tmp_path / "s.csv"), ss.CSV_TIME)
    assert back.exceptAll(table.select(*back.columns)).count() == 0 and back.count() == table.count()
