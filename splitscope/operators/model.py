"""Regression with confounders, drivers and the arm x device interaction.

The sessions are first reduced to one row per combination of the regressors' values, a
cell, with its session count and conversion count (a combinable aggregation). A grouped
binomial fit on those cells has the same coefficients and standard errors as the fit on
individual sessions. Newton's method then needs, in each round, sums over the cells of
matrices as large as the number of terms. Up to ``LOCAL_CELLS`` cells come to the driver
once; more stay distributed, and each round is one job that sums per task.

The models are fitted while the query is built and return a local table of terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import chi2_sf, normal_quantile, rnd, two_sided_p
from ..spec import DEFAULT_SPEC, ExperimentSpec
from .clean import normal

# Pre-treatment confounders the model controls for.
CONFOUNDERS = ("device_type", "cookie_segment", "country")

# Cells brought to the driver at most (some 10 MB); beyond them every round of a fit is a job.
LOCAL_CELLS = 200_000


def covariate_cells(
    clean_df: DataFrame, covariates: Sequence[str], outcome: str = "conversion", spec: ExperimentSpec = DEFAULT_SPEC
) -> DataFrame:
    """Sessions with a known outcome and successes per (arm, covariates) cell, of the two arms compared."""
    n = normal(clean_df, spec).filter(F.col(outcome).isNotNull() & F.col("test_group").isin(*spec.arms))
    return n.groupBy("test_group", *covariates).agg(
        F.count("*").alias("n"), F.sum(F.col(outcome).cast("bigint")).alias("x")
    )


@dataclass
class Sums:
    """What one round needs of the cells, added up: information and gradient."""

    info: np.ndarray
    score: np.ndarray


def cell_sums(design: np.ndarray, n: np.ndarray, x: np.ndarray, b: np.ndarray, inverse: np.ndarray | None) -> Sums:
    """Sums of some cells at the estimate ``b``; with the inverse information, the gradient is Firth's."""
    eta = np.clip(design @ b, -500, 500)
    mu = 1 / (1 + np.exp(-eta))
    w = n * mu * (1 - mu)
    residual = x - n * mu
    if inverse is not None:
        residual = residual + w * np.einsum("ij,jk,ik->i", design, inverse, design) * (0.5 - mu)
    return Sums((design * w[:, None]).T @ design, design.T @ residual)


def cell_signs(design: np.ndarray, n: np.ndarray, x: np.ndarray, d: np.ndarray) -> tuple[float, float, float]:
    """Along direction ``d``: the greatest move of a cell with both outcomes, the worst move of a
    cell with one outcome (negative: away from it), and the greatest move of all."""
    move = design @ d
    pure = (x == 0) | (x == n)
    toward = np.where(x == 0, -move, move)[pure]
    return (
        float(np.abs(move[~pure]).max(initial=0.0)),
        float(toward.min(initial=0.0)),
        float(np.abs(move).max(initial=0.0)),
    )


def _numbers(table: pa.Table | pa.RecordBatch, column: str) -> np.ndarray:
    return np.array(table.column(column).to_pylist(), dtype=float)


def _is(table: pa.Table | pa.RecordBatch, column: str, level: str | None) -> np.ndarray:
    return np.array([v == level for v in table.column(column).to_pylist()], dtype=float)


class Cells:
    """Cells of a model: ``keys`` columns, n and x, and the function that makes terms of the keys."""

    def __init__(self, cells: DataFrame, keys: Sequence[str], local_cells: int = LOCAL_CELLS):
        self.cells = cells.select(*keys, F.col("n").cast("double").alias("n"), F.col("x").cast("double").alias("x")).persist()
        head = self.cells.limit(local_cells + 1).toArrow()
        self.local = head if head.num_rows <= local_cells else None
        self.keys = list(keys)
        self.design: Callable[[pa.Table | pa.RecordBatch], np.ndarray] | None = None

    def values(self, key: str) -> list:
        """The values of one key in sort order, null last."""
        if self.local is not None:
            found = self.local.column(key).unique().to_pylist()
        else:
            found = [r[0] for r in self.cells.select(key).distinct().collect()]
        return sorted((v for v in found if v is not None)) + [None] * (None in found)

    def _parts(self, f: Callable[..., Sequence[float]]) -> list[np.ndarray]:
        """``f`` of (design, n, x) of all cells, or of each task's."""
        design = self.design

        def of(table) -> np.ndarray:
            return np.asarray(f(design(table), _numbers(table, "n"), _numbers(table, "x")), dtype=float)

        if self.local is not None:
            return [of(self.local)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([of(batch).tolist()], pa.list_(pa.float64()))], names=["v"])

        sums = self.cells.mapInArrow(run, "v array<double>")
        return [np.array(r.v) for r in sums.collect()]

    def sums(self, b: np.ndarray, inverse: np.ndarray | None) -> Sums:
        p = len(b)

        def flat(design, n, x):
            s = cell_sums(design, n, x, b, inverse)
            return np.concatenate([s.info.ravel(), s.score])

        total = np.sum([np.zeros(p * p + p), *self._parts(flat)], axis=0)
        return Sums(total[: p * p].reshape(p, p), total[p * p :])

    def signs(self, d: np.ndarray) -> tuple[float, float, float]:
        parts = [np.zeros(3), *self._parts(lambda *cell: cell_signs(*cell, d))]
        return max(p[0] for p in parts), min(p[1] for p in parts), max(p[2] for p in parts)

    def close(self) -> None:
        self.cells.unpersist()


def independent(info: np.ndarray, order: Sequence[int]) -> list[int]:
    """The terms, taken in ``order``, that are no linear combination of those before them
    (by pivots of the information matrix)."""
    m, kept = info.copy(), []
    for j in order:
        if m[j, j] > 1e-9 * max(info[j, j], 1e-300):
            kept.append(j)
            m = m - np.outer(m[:, j], m[j, :]) / m[j, j]
    return sorted(kept)


@dataclass
class Fit:
    """Estimates and standard errors of all terms (nan: a combination of others), whether the
    rounds settled, and the terms without a finite maximum-likelihood estimate."""

    b: np.ndarray
    se: np.ndarray
    settled: bool
    separated: np.ndarray


def newton(cells: Cells, p: int, *, firth: bool = False, max_iter: int = 50, tol: float = 1e-10) -> Fit:
    """Fit ``p`` terms, the last of them the intercept.

    Terms that are combinations of others (intercept first, then in order) are left out.
    With ``firth`` the likelihood is penalised by the root of the information's determinant
    (Jeffreys' prior), which has a finite maximum on every table. Without, a direction along
    which every cell with both outcomes stays and every cell with one moves towards it,
    or stays, proves that there is no finite maximum: the terms it moves are ``separated``.
    """
    nan = np.full(p, np.nan)
    at_zero = cells.sums(np.zeros(p), None)
    kept = independent(at_zero.info, [p - 1, *range(p - 1)])
    if not kept:
        return Fit(nan, nan.copy(), False, np.zeros(p, bool))
    pick = np.ix_(kept, kept)
    b, settled, before = np.zeros(p), False, []

    def inverse_at(b: np.ndarray) -> np.ndarray:
        out = np.zeros((p, p))
        out[pick] = np.linalg.pinv(cells.sums(b, None).info[pick], hermitian=True)
        return out

    inverse = inverse_at(b)
    for _ in range(max_iter):
        step = inverse @ cells.sums(b, inverse if firth else None).score
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-300))
        before.append(b)
        b = b + step
        if not np.isfinite(b).all():
            b = before[-1]
            break
        inverse = inverse_at(b)
        if np.abs(step).max() < tol * max(1.0, np.abs(b).max()):
            settled = True
            break
    separated = np.zeros(p, bool)
    if not firth and np.abs(b).max() > 8:
        # late moves follow the direction of a missing maximum, if there is one
        d = b - before[max(0, len(before) - 4)]
        size = np.abs(d).max()
        if size > 0:
            d = d / size
            stay, worst, most = cells.signs(d)
            if most > 0 and stay <= 1e-3 * most and worst >= -1e-3 * most:
                separated, settled = np.abs(d) > 1e-2, False
                inverse[separated, separated] = np.nan  # no maximum, no curvature there
    out, se = nan.copy(), nan.copy()
    out[kept], se[kept] = b[kept], np.sqrt(np.diag(inverse)[kept].clip(0))
    return Fit(out, se, settled, separated)


def _terms(spark, names: Sequence[str], fit: Fit | None) -> DataFrame:
    """A row for each term with its test; NULL figures where there is no estimate."""
    known = lambda v: None if fit is None or not np.isfinite(v) else float(v)
    rows = [
        (name, known(fit.b[i]), known(fit.se[i]), bool(fit.settled), bool(fit.separated[i])) if fit else (name, None, None, False, False)
        for i, name in enumerate(names)
    ]
    table = spark.createDataFrame(rows, "term string, b double, se double, converged boolean, separated boolean")
    tested = table.withColumn("z", F.col("b") / F.nullif(F.col("se"), F.lit(0.0))).withColumn("p", two_sided_p("z"))
    return tested.select(
        "term",
        rnd("b", 6).alias("coefficient"),
        rnd("se", 6).alias("std_error"),
        rnd("z", 4).alias("z_value"),
        rnd("p", 6).alias("p_value"),
        rnd(F.exp("b"), 6).alias("odds_ratio"),
        "converged",
        "separated",
    )


def driver_model(clean_df: DataFrame, max_iter: int = 50, spec: ExperimentSpec = DEFAULT_SPEC, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """Logistic regression of conversion on its drivers: widgets, filters, time on the dashboard
    (in half minutes, not rounded), device, arm, and the arm x device interaction.

    Reference device: the first in sort order. Rows with an unknown value of any driver and
    rows of other arms are left out. Terms that are combinations of others have NULL figures, as have
    all terms of an empty table; ``converged`` is false where the rounds did not settle.
    """
    keys = ["treated", "device_type", "widgets", "filters", "seconds"]
    known = normal(clean_df, spec).filter(F.col("test_group").isin(*spec.arms)).select(
        (F.col("test_group") == spec.treatment).cast("double").alias("treated"),
        "device_type",
        F.col("widgets_viewed").cast("double").alias("widgets"),
        F.col("filters_applied").cast("double").alias("filters"),
        F.col("time_on_dashboard_clean").cast("double").alias("seconds"),
        F.col("conversion").cast("bigint").alias("y"),
    ).dropna()
    cells = Cells(known.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("x")), keys, local_cells)
    try:
        devices = cells.values("device_type")[1:]

        def design(table) -> np.ndarray:
            treated = _numbers(table, "treated")
            out = [treated, _numbers(table, "widgets"), _numbers(table, "filters"), _numbers(table, "seconds") / 30]
            for d in devices:
                out += [_is(table, "device_type", d), treated * _is(table, "device_type", d)]
            return np.stack([*out, np.ones(len(treated))], axis=1)

        cells.design = design
        names = [f"treatment_{spec.treatment}", "widgets", "filters", "half_minutes"]
        for d in devices:
            names += [f"device_type={d}", f"treatment_{spec.treatment}:device_type={d}"]
        names.append("intercept")
        fit = newton(cells, len(names), max_iter=max_iter)
    finally:
        cells.close()
    return _terms(clean_df.sparkSession, names, fit).drop("separated")


def logit_model(
    clean_df: DataFrame,
    covariates: Sequence[str] = CONFOUNDERS,
    outcome: str = "conversion",
    max_iter: int = 50,
    spec: ExperimentSpec = DEFAULT_SPEC,
    firth: bool = False,
    local_cells: int = LOCAL_CELLS,
) -> DataFrame:
    """Logistic regression of the outcome on the treatment indicator plus dummy-coded
    confounders (reference level: the first in sort order; NULL is a level, the last).

    ``converged`` tells whether the fit settled within ``max_iter`` rounds; ``separated``
    marks the terms of a combination along which the outcomes come apart, so that
    they have no finite estimate: the coefficient is that of the last round, without an error.
    ``firth`` fits the penalised likelihood, whose estimates are finite there too. Terms that
    are combinations of others (one arm only, collinear confounders) have NULL figures;
    an empty table gives the treatment and the intercept without figures. Rows of other
    arms and of unknown outcome are left out.
    """
    raw = covariate_cells(clean_df, covariates, outcome, spec)
    cells = Cells(
        raw.select((F.col("test_group") == spec.treatment).cast("double").alias("_treated"), *[F.col(c).cast("string").alias(c) for c in covariates], "n", "x"),
        ["_treated", *covariates],
        local_cells,
    )
    try:
        terms = [(c, level) for c in covariates for level in cells.values(c)[1:]]

        def design(table) -> np.ndarray:
            out = [_numbers(table, "_treated"), *[_is(table, c, level) for c, level in terms]]
            return np.stack([*out, np.ones(len(out[0]))], axis=1)

        cells.design = design
        names = [f"treatment_{spec.treatment}", *[f"{c}={'NULL' if level is None else level}" for c, level in terms], "intercept"]
        fit = newton(cells, len(names), firth=firth, max_iter=max_iter)
    finally:
        cells.close()
    return _terms(clean_df.sparkSession, names, fit)


def firth_model(clean_df: DataFrame, covariates: Sequence[str] = CONFOUNDERS, outcome: str = "conversion", spec: ExperimentSpec = DEFAULT_SPEC) -> DataFrame:
    """``logit_model`` by Firth's penalised likelihood: finite estimates on every table."""
    return logit_model(clean_df, covariates, outcome, spec=spec, firth=True).drop("separated")


def interaction(
    clean_df: DataFrame, dim: str = "device_type", outcome: str = "conversion", spec: ExperimentSpec = DEFAULT_SPEC
) -> DataFrame:
    """Arm x ``dim`` interaction on the log-odds scale, closed form.

    For the saturated model ``logit(p) ~ arm * dim`` the treatment log-odds ratio in
    level d is ``logit(p_B,d) - logit(p_A,d)``, and the interaction coefficient of d
    is its difference to the reference level (first in sort order), with
    ``SE = sqrt(sum 1/cell count)`` over the four cells involved.
    """
    n = normal(clean_df, spec)
    is_a = F.col("test_group") == spec.control
    is_b = F.col("test_group") == spec.treatment
    y = F.col(outcome).cast("double")
    per = n.groupBy(dim).agg(
        F.count_if(is_a & y.isNotNull()).cast("double").alias("n_a"),
        F.count_if(is_b & y.isNotNull()).cast("double").alias("n_b"),
        F.coalesce(F.sum(F.when(is_a, y)), F.lit(0.0)).alias("x_a"),
        F.coalesce(F.sum(F.when(is_b, y)), F.lit(0.0)).alias("x_b"),
    ).filter((F.col("n_a") > 0) & (F.col("n_b") > 0))
    lor = F.log(F.col("x_b") / F.nullif(F.col("n_b") - F.col("x_b"), F.lit(0.0))) - F.log(
        F.col("x_a") / F.nullif(F.col("n_a") - F.col("x_a"), F.lit(0.0))
    )
    var = (
        F.lit(1.0) / F.nullif(F.col("x_a"), F.lit(0.0))
        + F.lit(1.0) / F.nullif(F.col("n_a") - F.col("x_a"), F.lit(0.0))
        + F.lit(1.0) / F.nullif(F.col("x_b"), F.lit(0.0))
        + F.lit(1.0) / F.nullif(F.col("n_b") - F.col("x_b"), F.lit(0.0))
    )
    per = per.select(dim, "n_a", "n_b", "x_a", "x_b", lor.alias("lor"), var.alias("var"))
    # reference level over the few aggregated rows
    w = Window.orderBy(dim).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ref = per.withColumn("ref_lor", F.first("lor").over(w)).withColumn("ref_var", F.first("var").over(w))
    ref = ref.withColumn("is_ref", F.col(dim) == F.first(dim).over(w))
    inter = F.when(F.col("is_ref"), F.lit(0.0)).otherwise(F.col("lor") - F.col("ref_lor"))
    se = F.when(F.col("is_ref"), F.lit(None).cast("double")).otherwise(F.sqrt(F.col("var") + F.col("ref_var")))
    z = inter / F.nullif(se, F.lit(0.0))
    return ref.select(
        dim,
        rnd(F.col("x_a") / F.col("n_a") * 100, 2).alias("rate_a_pct"),
        rnd(F.col("x_b") / F.col("n_b") * 100, 2).alias("rate_b_pct"),
        rnd("lor", 6).alias("log_odds_ratio"),
        rnd(F.exp("lor"), 6).alias("odds_ratio"),
        rnd(inter, 6).alias("interaction"),
        rnd(se, 6).alias("interaction_se"),
        rnd(two_sided_p(z), 4).alias("interaction_p_value"),
    ).orderBy(dim)


def _log_odds(clean_df: DataFrame, dim: str, outcome: str, spec: ExperimentSpec) -> DataFrame:
    """Per level of ``dim``: the four counts a, b (treated with and without the outcome), c, d (control)."""
    n = normal(clean_df, spec).filter(F.col(outcome).isNotNull())
    y = F.col(outcome).cast("double")
    per = n.groupBy(dim).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("test_group") == arm, v)), F.lit(0.0)).alias(name)
            for arm, pair in ((spec.treatment, "ab"), (spec.control, "cd"))
            for name, v in zip(pair, (y, 1 - y), strict=True)
        ]
    )
    return per.filter((F.col("a") + F.col("b") > 0) & (F.col("c") + F.col("d") > 0))


def interaction_test(
    clean_df: DataFrame, dim: str = "device_type", outcome: str = "conversion", spec: ExperimentSpec = DEFAULT_SPEC
) -> DataFrame:
    """Does the arm's effect differ between the levels of ``dim``? One joint test (Woolf). One row.

    The weighted squared distances of the levels' log odds ratios from their mean,
    weights one over variance, follow chi-square with levels - 1 degrees of freedom if one odds
    ratio holds everywhere. Levels with an empty cell have no log odds ratio: they are
    counted, not tested. Fewer than two tested levels: statistic and p are NULL.
    """
    per = _log_odds(clean_df, dim, outcome, spec)
    a, b, c, d = (F.nullif(F.col(x), F.lit(0.0)) for x in "abcd")
    per = per.select(F.log(a * d / (b * c)).alias("lor"), (1 / (1 / a + 1 / b + 1 / c + 1 / d)).alias("w"))
    # the mean is a column of the few levels: one more step, no second pass
    mean = F.sum(F.col("w") * F.col("lor")).over(Window.partitionBy()) / F.sum("w").over(Window.partitionBy())
    one = per.withColumn("mean", mean).agg(
        F.count("lor").alias("levels"),
        F.count_if(F.col("lor").isNull()).alias("levels_without_estimate"),
        F.max("mean").alias("mean"),
        F.sum(F.col("w") * F.pow(F.col("lor") - F.col("mean"), 2)).alias("q"),
    )
    one = one.filter("levels + levels_without_estimate > 0").withColumn("dof", (F.col("levels") - 1).cast("bigint"))
    tested = one.withColumns({"stat": F.when(F.col("dof") > 0, F.col("q")), "p": F.when(F.col("dof") > 0, chi2_sf("q", "dof"))})
    return tested.select(
        F.lit(dim).alias("dimension"),
        "levels",
        "levels_without_estimate",
        rnd(F.exp("mean"), 6).alias("pooled_odds_ratio"),
        rnd("stat", 4).alias("chi_square_statistic"),
        F.greatest("dof", F.lit(0)).alias("degrees_of_freedom"),
        rnd("p", 6).alias("p_value"),
        F.when(F.col("p") < spec.alpha, "INTERACTION - the effect differs between levels").when(F.col("p").isNotNull(), "NO INTERACTION - one effect fits all levels").alias("conclusion"),
    )


def adjusted_effect(
    clean_df: DataFrame, dim: str = "cookie_segment", outcome: str = "conversion", spec: ExperimentSpec = DEFAULT_SPEC
) -> DataFrame:
    """The arm's effect adjusted for ``dim`` (Mantel-Haenszel), beside the crude one. One row.

    Common odds ratio and risk difference over the strata seen in both arms, the Robins-Breslow-Greenland
    confidence interval of the odds ratio, and the Cochran-Mantel-Haenszel test (no continuity
    correction). ``reversed`` tells whether crude and adjusted difference have opposite
    signs, Simpson's paradox in the form that matters for a decision.
    """
    a, b, c, d = (F.col(x) for x in "abcd")
    n1, n0, n, hits = a + b, c + d, a + b + c + d, a + c
    sums = {
        "a": a, "b": b, "c": c, "d": d,
        "r": a * d / n,
        "s": b * c / n,
        "pr": (a + d) / n * (a * d / n),
        "ps": (a + d) / n * (b * c / n),
        "qr": (b + c) / n * (a * d / n),
        "qs": (b + c) / n * (b * c / n),
        "excess": a - n1 * hits / n,
        "variance": n1 * n0 * hits * (n - hits) / (n * n * F.nullif(n - 1, F.lit(0.0))),
        "weight": n1 * n0 / n,
        "weighted": (a * n0 - c * n1) / n,
    }
    one = _log_odds(clean_df, dim, outcome, spec).agg(F.count("*").alias("strata"), *[F.sum(v).alias(k) for k, v in sums.items()])
    zero = F.lit(0.0)
    one = one.filter("strata > 0").withColumns(
        {
            "crude_or": F.col("a") * F.col("d") / F.nullif(F.col("b") * F.col("c"), zero),
            "or": F.col("r") / F.nullif(F.col("s"), zero),
            "crude": F.col("a") / (F.col("a") + F.col("b")) - F.col("c") / (F.col("c") + F.col("d")),
            "adjusted": F.col("weighted") / F.col("weight"),
            "stat": F.col("excess") * F.col("excess") / F.nullif(F.col("variance"), zero),
            "var": F.col("pr") / F.nullif(2 * F.col("r") * F.col("r"), zero)
            + (F.col("ps") + F.col("qr")) / F.nullif(2 * F.col("r") * F.col("s"), zero)
            + F.col("qs") / F.nullif(2 * F.col("s") * F.col("s"), zero),
        }
    )
    margin = F.lit(normal_quantile(1 - spec.alpha / 2)) * F.sqrt("var")
    return one.withColumn("p", chi2_sf("stat", F.lit(1))).select(
        F.lit(dim).alias("dimension"),
        "strata",
        rnd("crude_or", 6).alias("crude_odds_ratio"),
        rnd("or", 6).alias("adjusted_odds_ratio"),
        rnd(F.exp(F.log("or") - margin), 6).alias("ci_low"),
        rnd(F.exp(F.log("or") + margin), 6).alias("ci_high"),
        rnd(F.col("crude") * 100, 4).alias("crude_diff_pp"),
        rnd(F.col("adjusted") * 100, 4).alias("adjusted_diff_pp"),
        rnd("stat", 4).alias("cmh_statistic"),
        rnd("p", 6).alias("p_value"),
        F.when(F.signum("crude") * F.signum("adjusted") < 0, "YES").otherwise("NO").alias("reversed"),
    )
