"""Exact Mann-Whitney tail for small untied samples.

With m <= 8 values in the smaller sample, n in the larger one and no ties, every
choice of m ranks out of m + n is equally likely, and the choices with U <= u are
counted by a Gaussian binomial::

    count(u) = [q^u]  prod_i (1 - q^(n+i)) / ((1 - q) prod_i (1 - q^i)),   i = 1..m

The numerator is a short signed sum of powers (``TERMS``: its exponents are
``j n + e``).  The rest counts partitions into parts up to m: with L = lcm(1..m) it is
``P(q) / (1 - q^L)^(m+1)`` for a fixed polynomial P, so its coefficient at x is the sum of
``P[x mod L + t L] * C(x div L - t + m, m)`` over t = 0..m.  A test therefore costs a
few hundred terms, however large n is; they are joins with two fixed tables.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranks import values_below
from ..plans.store import stored

#: The exact test serves samples of which the smaller has at most so many values.
EXACT_MOST = 8


@lru_cache
def partition_polynomial(m: int) -> tuple[int, list[int]]:
    """L and P's coefficients for parts 1, 1..m (the extra 1 adds the counts up)."""
    period, poly = math.lcm(*range(1, m + 1)), [1]
    for part in (1, *range(1, m + 1)):
        poly = [a - b for a, b in zip(poly + [0] * period, [0] * period + poly, strict=True)]  # times 1 - q^L
        for i in range(part, len(poly)):  # over 1 - q^part
            poly[i] += poly[i - part]
    return period, poly


@lru_cache
def signed_terms(m: int) -> dict[tuple[int, int], int]:
    """(j, e) -> coefficient of q^(j n + e) in the numerator."""
    out = Counter({(0, 0): 1})
    for i in range(1, m + 1):
        for (j, e), c in list(out.items()):
            out[j + 1, e + i] -= c
    return {k: c for k, c in out.items() if c}


def _terms(spark: SparkSession) -> DataFrame:
    rows = [(m, partition_polynomial(m)[0], j, e, float(c))
            for m in range(1, EXACT_MOST + 1) for (j, e), c in signed_terms(m).items()]
    return spark.createDataFrame(rows, "m long, period long, j long, e long, c double")


def _coefficients(spark: SparkSession) -> DataFrame:
    rows = []
    for m in range(1, EXACT_MOST + 1):
        period, poly = partition_polynomial(m)
        rows += [(m, k % period, k // period, float(p)) for k, p in enumerate(poly) if p]
    return spark.createDataFrame(rows, "m long, k long, t long, p double")


def _choose(top: Column) -> Column:
    """C(top + m, m) as a double."""
    return reduce(lambda acc, i: acc * F.when(F.col("m") >= i, (top + F.lit(i)) / F.lit(float(i))).otherwise(F.lit(1.0)),
                  range(1, EXACT_MOST + 1), F.lit(1.0))


def with_exact_p(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """``stats`` (a row a test, told apart by ``by``; n1, n2, u1, u2, tie_term) with ``p_exact``:
    the two-sided exact p-value ``min(1, 2 P(U <= min(u1, u2)))``; NULL where a sample
    is empty, values are tied or both samples have over ``EXACT_MOST`` values."""
    spark = stats.sparkSession
    small = stats.where((F.least("n1", "n2") >= 1) & (F.least("n1", "n2") <= EXACT_MOST) & (F.col("tie_term") == 0))
    one = small.select(*by, F.least("n1", "n2").alias("m"), F.greatest("n1", "n2").alias("n"),
                       F.least("u1", "u2").cast("long").alias("u"))
    at = one.join(F.broadcast(_terms(spark)), "m").withColumn("x", F.expr("u - j * n - e")).where("x >= 0")
    at = at.withColumn("k", F.expr("x % period")).withColumn("y", F.expr("x div period"))
    at = at.join(F.broadcast(_coefficients(spark)), ["m", "k"]).where("y >= t")
    ways = F.col("c") * F.col("p") * _choose((F.col("y") - F.col("t")).cast("double"))
    found = at.groupBy(*by).agg(F.sum(ways / _choose(F.col("n").cast("double"))).alias("tail"))
    found = found.select(*[F.col(c).alias(f"_{c}") for c in by], F.least(F.lit(1.0), F.lit(2.0) * F.col("tail")).alias("p_exact"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    return stats.join(found, same, "left").drop(*[f"_{c}" for c in by])


def rank_tests(samples: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mann-Whitney U of ``sample`` 1 against 2 in every group of ``by``: n1, n2, u1, u2,
    tie_term and ``p_exact``.  NULL values take no part."""
    vc = stored(samples.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count_if(F.col("sample") == 1).alias("c1"), F.count_if(F.col("sample") == 2).alias("c2"),
        F.count("*").alias("c")), "values")
    dec = lambda c: F.col(c).cast("decimal(38,0)")
    a = values_below(vc, value, "c", by).groupBy(*by).agg(
        F.sum("c1").alias("n1"), F.sum("c2").alias("n2"),
        F.sum(dec("c1") * (F.lit(2) * dec("below") + dec("c") + F.lit(1))).alias("two_r1"),
        F.sum(dec("c") * dec("c") * dec("c") - dec("c")).cast("double").alias("tie_term"))
    u1 = (F.col("two_r1") / F.lit(2) - dec("n1") * (dec("n1") + F.lit(1)) / F.lit(2)).cast("double")
    a = a.select(*by, "n1", "n2", u1.alias("u1"), "tie_term")
    return with_exact_p(a.withColumn("u2", F.col("n1").cast("double") * F.col("n2").cast("double") - F.col("u1")), by)
