"""Column-expression helpers shared by every operator.

All of these are plain ``pyspark.sql.functions`` compositions: they stay inside
whole-stage codegen and never call back into Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: str | Column, digits: int) -> Column:
    """Decimal rounding, half away from zero, returned as DOUBLE; one rule for all values.

    Rounded to ten decimals first, so binary fuzz of a double (``2.675`` held as
    ``2.67499999...``) cannot flip the last kept digit. Spark rounds doubles on their
    decimal expansion, whatever their magnitude; NaN and infinities stay as they are.
    """
    return F.round(F.round(col(c).cast("double"), 10), digits)


def pct(c: str | Column, digits: int = 2) -> Column:
    """``ROUND(AVG(flag) * 100, digits)``."""
    return rnd(F.avg(col(c)) * F.lit(100), digits)


def avg_d(c: str | Column) -> Column:
    """Average in double precision (decimals are cast first)."""
    return F.avg(col(c).cast("double"))


def stddev0(c: str | Column) -> Column:
    """Sample standard deviation that is 0 (not NULL) for a one-value group."""
    return F.when(F.count(col(c)) == 1, F.lit(0.0)).otherwise(F.stddev_samp(col(c).cast("double")))


def flag(cond: Column) -> Column:
    """0/1 integer from a predicate; NULL counts as 0 (SQL ``CASE WHEN cond THEN 1 ELSE 0``)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


# Where the power series of the normal tail hands over to its continued fraction, and the
# terms of each; with these both hold a relative error below 1e-12 there and less elsewhere.
_HANDOVER, _SERIES, _FRACTION = 3.0, 40, 60


def _upper_tail(z: Column) -> Column:
    """``P(Z > z)`` for ``z >= 0``, with small relative error however small the tail.

    Below the handover ``1/2 - phi(z) (z + z^3/3 + z^5/(3*5) + ...)``, whose terms are all
    positive; above it ``phi(z) / (z + 1/(z + 2/(z + 3/(...))))``.
    """
    density = F.exp(z * z * F.lit(-0.5)) * F.lit(1.0 / math.sqrt(2.0 * math.pi))
    # loops rather than written-out terms: the plan stays small, and there is a tail for each result row only
    term = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_SERIES)),
        term,
        lambda acc, k: F.struct((acc["t"] * z * z / (k * 2 + 1)).alias("t"), (acc["s"] + acc["t"] * z * z / (k * 2 + 1)).alias("s")),
        lambda acc: acc["s"],
    )
    fraction = F.aggregate(F.sequence(F.lit(_FRACTION), F.lit(1)), z, lambda acc, k: z + k / acc)
    return F.when(z < F.lit(_HANDOVER), F.lit(0.5) - density * z * series).otherwise(density / fraction)


def normal_sf(z: str | Column) -> Column:
    """Upper tail ``P(Z > z)`` of the standard normal."""
    tail = once(F.abs(col(z).cast("double")), _upper_tail)
    return F.when(col(z) < 0, F.lit(1.0) - tail).otherwise(tail)


def normal_cdf(z: str | Column) -> Column:
    """Standard normal CDF as a column expression."""
    return normal_sf(-col(z).cast("double"))


def two_sided_p(z: str | Column) -> Column:
    return F.lit(2.0) * normal_sf(F.abs(col(z)))


def _chi2_tail(x: Column, k: Column) -> Column:
    """Chi-square upper tail and density at ``x > 0`` for integer ``k >= 1``: struct (sf, pdf).

    even k: the tail is ``sum_{i<k/2} exp(-x/2) (x/2)^i / i!``
    odd k:  ``2 P(Z > sqrt x) + sum_{i=1}^{(k-1)/2} sqrt(2x/pi) exp(-x/2) x^(i-1) / (1*3*...*(2i-1))``
    Half the last term (for k = 1: of the term i = 0) is the density. The terms are carried as
    logarithms, so no df or statistic under- or overflows; the sums are built with
    ``aggregate`` over ``sequence``, so ``k`` may come from the data.
    """
    half = x / F.lit(2.0)
    even = k % 2 == 0
    # i runs from 0 in both; the term 0 of odd k is no part of the tail
    start = F.when(even, -half).otherwise(F.lit(0.5) * F.ln(F.lit(2.0 / math.pi) / x) - half)
    last = F.floor((k - 1) / 2).cast("int")

    def add(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.ln(F.when(even, half / i).otherwise(x / (i * 2 - 1)))
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    first = F.struct(start.alias("t"), F.when(even, F.exp(start)).otherwise(F.lit(2.0) * normal_sf(F.sqrt(x))).alias("s"))
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, first, add, lambda acc: F.struct(acc["s"].alias("sf"), (F.exp(acc["t"]) / 2).alias("pdf")))


def chi2_sf(stat: str | Column, df: str | Column) -> Column:
    """Chi-square upper tail ``P(X > stat)`` for integer ``df >= 1`` (1 for a statistic of 0 or less)."""
    x = col(stat).cast("double")
    return F.when(x <= 0, F.lit(1.0)).otherwise(_chi2_tail(x, col(df).cast("int"))["sf"])


def normal_quantile(p: float) -> float:
    """Inverse standard normal CDF of a parameter (driver-side scalar, not data)."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def chi2_critical_col(df: str | Column, alpha: float, steps: int = 12) -> Column:
    """Critical value at ``alpha`` for any ``df >= 1`` (NULL below), to three decimals as in
    printed tables.

    Newton's method on the logarithm of the tail, from the Wilson-Hilferty value.
    """
    k = col(df).cast("int")
    spread = F.lit(2.0) / (k * 9)
    cube = F.pow(F.lit(1.0) - spread + F.lit(normal_quantile(1 - alpha)) * F.sqrt(spread), 3)
    start = F.greatest(k * cube, F.lit(0.01))

    def improve(x: Column, _: Column) -> Column:
        better = once(_chi2_tail(x, k), lambda t: x + F.ln(t["sf"] / F.lit(alpha)) * t["sf"] / t["pdf"])
        return F.greatest(better, x / 8)

    return F.when(k >= 1, rnd(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, improve), 3))
