"""Numeric expressions with NumPy/pandas rounding semantics.

pandas ``round(d)`` scales, rounds half to even and unscales
(``rint(x * 10**d) / 10**d``).  Spark's ``round`` rounds half up on the decimal
representation and ``bround`` on the exact decimal; neither matches, so every
rounding in the library goes through :func:`round_half_even`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_even(x, digits: int) -> Column:
    """``rint(x * 10^d) / 10^d`` — equal to ``numpy.round`` / ``Series.round``."""
    scale = F.lit(float(10 ** digits))
    return F.rint(_c(x) * scale) / scale


def stable(x, digits: int = 6) -> Column:
    """Final presentation rounding of a ratio or statistic (6 dp by default)."""
    return round_half_even(x, digits)


def line_cents(price, qty) -> Column:
    """Cents of ``round(price * qty, 2)`` with NumPy's half-even rule."""
    return F.rint(_c(price) * _c(qty).cast("double") * F.lit(100.0)).cast("bigint")


def money(cents) -> Column:
    """Cents back to a currency ``double``."""
    return _c(cents).cast("double") / F.lit(100.0)


def ratio(num, den) -> Column:
    """``num / den`` as double, NULL (not an error, not inf) when ``den`` is 0."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def lerp(a, b, t) -> Column:
    """NumPy's two-sided linear interpolation (``numpy.lib._lerp``).

    ``a + (b-a)*t`` for ``t < 0.5``, else ``b - (b-a)*(1-t)``; both engines must
    use this exact form for bit-equal quantiles.
    """
    a, b, t = _c(a), _c(b), _c(t)
    d = b - a
    return F.when(t >= F.lit(0.5), b - d * (F.lit(1.0) - t)).otherwise(a + d * t)


_TWO32 = 4294967296


def exact_double(x) -> Column:
    """Correctly rounded ``double`` of an exact integer ``decimal`` (|x| < 2^85).

    ``hi * 2^32 + lo`` with both parts exact in double: the one final addition
    rounds correctly, so every IEEE engine gets the same bits (a plain
    decimal/128-bit cast is not correctly rounded everywhere).
    """
    x = _c(x).cast("decimal(38,0)")
    a = F.abs(x)
    lo = F.pmod(a, F.lit(_TWO32).cast("decimal(38,0)"))
    hi = ((a - lo) / F.lit(_TWO32).cast("decimal(38,0)")).cast("decimal(38,0)")
    mag = hi.cast("double") * F.lit(float(_TWO32)) + lo.cast("double")
    return F.when(x < 0, -mag).otherwise(mag)


def dec(x) -> Column:
    return _c(x).cast("decimal(38,0)")
