"""Tail probabilities of the test statistics, as expressions over built-in functions.

* Student t, two-sided: ``p = I_x(df/2, 1/2)`` with ``x = df / (df + t^2)``, the
  regularised incomplete beta by its continued fraction (modified Lentz): a fold
  over the steps that stands still once a step changes nothing.
* Normal, two-sided: ``p = erfc(|z| / sqrt 2)``, by the series of erf below 2 and by the
  continued fraction of erfc from there on.

They run on one row per test; missing arguments and degrees of freedom of 0 or less
give NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPS = 1e-16
_TINY = 1e-300
STEPS = 5_000


def _guard(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def ln_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series at z + 10."""
    w = z + F.lit(10.0)
    series = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188]
    out = (w - F.lit(0.5)) * F.ln(w) - w + F.lit(0.5 * math.log(2 * math.pi))
    for k, c in enumerate(series):
        out = out + F.lit(c) / F.pow(w, F.lit(2.0 * k + 1))
    for i in range(10):
        out = out - F.ln(z + F.lit(float(i)))
    return out


def _fraction(coefficient, start: Column, steps: int) -> Column:
    """``start + d1 / (b1 + d2 / (b2 + ...))`` for ``coefficient(j) = (d_j, b_j)``."""
    first = F.struct(_guard(start).alias("c"), F.lit(0.0).alias("d"), _guard(start).alias("f"), F.lit(False).alias("done"))

    def step(s: Column, j: Column) -> Column:
        num, den = coefficient(j.cast("double"))
        d = F.lit(1.0) / _guard(den + num * s["d"])
        c = _guard(den + num / s["c"])
        moved = F.struct(c.alias("c"), d.alias("d"), (s["f"] * c * d).alias("f"),
                         (F.abs(c * d - F.lit(1.0)) < _EPS).alias("done"))
        return F.when(s["done"], s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step, lambda s: s["f"])


def _beta_lower(a: Column, b: Column, x: Column) -> Column:
    """``I_x(a, b)`` by its fraction, which converges fast for ``x < (a + 1) / (a + b + 2)``."""
    def coefficient(j: Column):
        m = F.floor(j / F.lit(2.0)).cast("double")
        even = m * (b - m) * x / ((a + j - F.lit(1.0)) * (a + j))
        odd = -(a + m) * (a + b + m) * x / ((a + j - F.lit(1.0)) * (a + j))
        return F.when(j == F.lit(2.0) * m, even).otherwise(odd), F.lit(1.0)
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.log1p(-x)) / a
    return front / _fraction(coefficient, F.lit(1.0), STEPS)


def betainc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta ``I_x(a, b)``."""
    near = x < (a + F.lit(1.0)) / (a + b + F.lit(2.0))
    return F.when(x <= 0.0, F.lit(0.0)).when(x >= 1.0, F.lit(1.0)).when(near, _beta_lower(a, b, x)) \
            .otherwise(F.lit(1.0) - _beta_lower(b, a, F.lit(1.0) - x))


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t."""
    p = F.least(F.lit(1.0), betainc(df / F.lit(2.0), F.lit(0.5), df / (df + t * t)))
    return F.when(t.isNull() | df.isNull() | F.isnan(t) | F.isnan(df) | (df <= 0), F.lit(None).cast("double")) \
            .when(F.abs(t) == F.lit(math.inf), F.lit(0.0)).otherwise(p)


def z_pvalue(z: Column) -> Column:
    """Two-sided p-value of a standard normal deviate."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    # erf x = 2 / sqrt(pi) e^(-x^2) sum 2^n x^(2n+1) / (1 3 ... (2n+1))
    first = F.struct(x.alias("term"), x.alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), first, lambda s, n: F.struct(
        (s["term"] * F.lit(2.0) * x * x / (F.lit(2.0) * n.cast("double") + F.lit(1.0))).alias("term"),
        (s["sum"] + s["term"] * F.lit(2.0) * x * x / (F.lit(2.0) * n.cast("double") + F.lit(1.0))).alias("sum")), lambda s: s["sum"])
    low = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-x * x) * series
    # erfc x = e^(-x^2) / sqrt(pi) / (x + (1/2) / (x + 1 / (x + (3/2) / ...)))
    high = F.exp(-x * x) / F.lit(math.sqrt(math.pi)) / _fraction(lambda j: (j / F.lit(2.0), x), x, 200)
    return F.when(z.isNull() | F.isnan(z), F.lit(None).cast("double")).when(x < 2.0, low).when(x > 40.0, F.lit(0.0)).otherwise(high)
