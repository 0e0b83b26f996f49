"""Distributions: histograms, box statistics, weekday AOV.

Histogram binning reproduces ``numpy.histogram`` with equal bins exactly:
edges ``lo + i*step`` (``linspace``), index ``int((v-lo)/(hi-lo)*bins)``
corrected against the edges, last bin closed.  The per-group ranges come
from a one-row-per-group aggregate joined back with a size-checked
broadcast (never a window over a group, never a shuffle of rows by a few keys).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import WEEKDAYS, day_name
from ..plans.quantiles import medians, quantiles, value_counts
from ..plans.lookups import checked, lookup_join
from ..plans.scalars import attach_row


def _edge(i: Column, lo: Column, hi: Column, bins: int) -> Column:
    step = (hi - lo) / F.lit(float(bins))
    return F.when(i >= F.lit(bins), hi).otherwise(i.cast("double") * step + lo)


def bin_index(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """numpy's equal-bin index of ``v`` in ``[lo, hi]`` (0 … bins-1)."""
    f = ((v - lo) / (hi - lo)) * F.lit(float(bins))
    i0 = f.cast("int")
    i0 = F.when(i0 == F.lit(bins), F.lit(bins - 1)).otherwise(i0)
    dec = F.when(v < _edge(i0, lo, hi, bins), i0 - 1).otherwise(i0)
    inc = F.when((v >= _edge(dec + 1, lo, hi, bins)) & (dec != F.lit(bins - 1)), dec + 1).otherwise(dec)
    return inc


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = (),
              counts: DataFrame | None = None) -> DataFrame:
    """``np.histogram(x, bins)`` per group: every bin (empty ones too) with edges,
    count and density (``count / width / total``).

    Works on the distinct-value counts of the column (``counts``, or
    :func:`~orderscope.plans.quantiles.value_counts` of ``df``): a bin's count
    is the sum of its values' counts.
    """
    keys = list(by)
    vc = value_counts(df, value, keys) if counts is None else counts
    rng = vc.groupBy(*keys).agg(F.min("v").alias("lo0"), F.max("v").alias("hi0"),
                                F.sum("c").alias("total"))
    same = F.col("lo0") == F.col("hi0")
    rng = rng.select(*keys, "total",
                     F.when(same, F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
                     F.when(same, F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"))
    # one range row per group (the global case is exactly one row), computed
    # once: it feeds both the binning join and the grid of empty bins
    rng, size = checked(rng)
    j = lookup_join(vc, rng, keys, size=size)
    counts_ = j.select(*keys, bin_index(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin"), "c") \
               .groupBy(*keys, "bin").agg(F.sum("c").alias("count"))
    grid = rng.select(*keys, "lo", "hi", "total",
                      F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts_, keys + ["bin"], "left").fillna(0, ["count"])
    lo_e = _edge(F.col("bin"), F.col("lo"), F.col("hi"), bins)
    hi_e = _edge(F.col("bin") + 1, F.col("lo"), F.col("hi"), bins)
    return out.select(*keys, "bin", lo_e.alias("bin_lo"), hi_e.alias("bin_hi"), "count",
                      (F.col("count").cast("double") / (hi_e - lo_e) / F.col("total").cast("double"))
                      .alias("density"))


def revenue_histogram(sales: DataFrame, bins: int = 60) -> DataFrame:
    """60-bin order-value histogram with the overall mean and median.

    One scan of ``sales``: histogram, mean and median all come from the
    distinct order values with their counts.  The mean is exact: ``revenue``
    is ``cents / 100``, so ``rint(v * 100)`` gives the cents back.
    """
    vc = value_counts(sales, "revenue")
    h = histogram(sales, "revenue", bins, counts=vc) \
        .select("bin", "bin_lo", "bin_hi", F.col("count").alias("orders"))
    cents = F.rint(F.col("v") * F.lit(100.0)).cast("bigint") * F.col("c")
    stats = vc.agg((F.sum(cents).cast("double") / F.sum("c").cast("double") / F.lit(100.0))
                   .alias("mean_revenue"))
    med = medians(sales, "revenue", out="median_revenue", counts=vc)
    return attach_row(h, attach_row(stats, med))  # one row each


def weekend_density(sales: DataFrame, bins: int = 50) -> DataFrame:
    """Density histograms of order value, weekend vs weekday, own range each."""
    x = sales.select((F.weekday("order_date") >= 5).alias("is_weekend"), "revenue")
    return histogram(x, "revenue", bins, ["is_weekend"]).withColumnRenamed("count", "orders")


def box_stats(df: DataFrame, value: str, by: Sequence[str], whis: float = 1.5) -> DataFrame:
    """Matplotlib ``boxplot`` statistics per group.

    q1/median/q3 by ``np.percentile``; whiskers at the most extreme values
    inside ``whis * IQR`` (falling back to q3/q1); flier count outside them.

    Everything runs on the column's distinct-value counts (one scan of
    ``df``).  After the quantiles, one aggregation gives the rest: a value
    is above the upper whisker exactly when it is above ``q3 + whis*IQR``
    (the whisker is the largest value not above that bound) or, when the
    whisker falls back to q3, above q3; both counts are taken and the right
    one picked (the same for the lower side); counts are sums of ``c``.
    """
    keys = list(by)
    vc = value_counts(df, value, keys)  # one scan; everything below reads it
    q = quantiles(df, value, [0.25, 0.5, 0.75], keys, out=["q1", "median", "q3"], with_count=True,
                  counts=vc)
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
         .withColumn("loval", F.col("q1") - F.lit(whis) * F.col("iqr")) \
         .withColumn("hival", F.col("q3") + F.lit(whis) * F.col("iqr"))
    j = lookup_join(vc, q, keys)  # one row of statistics per group
    v, c = F.col("v"), F.col("c")

    def rows_where(cond):
        return F.coalesce(F.sum(F.when(cond, c)), F.lit(0)).cast("bigint")

    a = j.groupBy(*keys).agg(
        F.max(F.when(v <= F.col("hival"), v)).alias("hi_in"),
        F.min(F.when(v >= F.col("loval"), v)).alias("lo_in"),
        rows_where(v > F.col("hival")).alias("above_hival"),
        rows_where(v > F.col("q3")).alias("above_q3"),
        rows_where(v < F.col("loval")).alias("below_loval"),
        rows_where(v < F.col("q1")).alias("below_q1"),
        *[F.max(x).alias(x) for x in ("q1", "median", "q3", "n")])
    hi_falls_back = F.col("hi_in").isNull() | (F.col("hi_in") < F.col("q3"))
    lo_falls_back = F.col("lo_in").isNull() | (F.col("lo_in") > F.col("q1"))
    whi = F.when(hi_falls_back, F.col("q3")).otherwise(F.col("hi_in"))
    wlo = F.when(lo_falls_back, F.col("q1")).otherwise(F.col("lo_in"))
    outliers = F.when(hi_falls_back, F.col("above_q3")).otherwise(F.col("above_hival")) \
        + F.when(lo_falls_back, F.col("below_q1")).otherwise(F.col("below_loval"))
    return a.select(*keys, F.col("n").alias("count"), "q1", "median", "q3",
                    wlo.alias("whisker_lo"), whi.alias("whisker_hi"), outliers.alias("outliers"))


def category_boxplot(sales: DataFrame) -> DataFrame:
    """D3: order-value box statistics per category, with the median order (1 = lowest)."""
    from pyspark.sql import Window
    b = box_stats(sales, "revenue", ["category"])
    return b.withColumn("median_rank", F.row_number().over(Window.orderBy("median", "category")))


def q4_boxplot(monthly: DataFrame) -> DataFrame:
    """Box statistics of monthly revenue, Q4 months vs the rest.

    ``monthly`` has ``year_month`` and ``revenue``; one row per month.
    """
    m = monthly.select((F.quarter("year_month") == 4).alias("is_q4"), "revenue")
    return box_stats(m, "revenue", ["is_q4"])


def aov_by_weekday(sales: DataFrame) -> DataFrame:
    """Mean order value per weekday, Monday-first (all seven rows)."""
    g = sales.groupBy(day_name("order_date").alias("day_of_week")).agg(
        F.sum("cents").alias("c"), F.count(F.lit(1)).alias("n"))
    days = sales.sparkSession.createDataFrame([(d, i) for i, d in enumerate(WEEKDAYS)],
                                              "day_of_week string, dow_index int")
    j = days.join(F.broadcast(g), "day_of_week", "left")  # g has at most 7 rows
    return j.select("day_of_week", "dow_index",
                    (F.col("c").cast("double") / F.col("n").cast("double") / F.lit(100.0)).alias("aov"))
