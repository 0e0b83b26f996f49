"""Trend + month-of-year OLS forecast in closed form.

OLS of ``revenue ~ t + 12 month dummies (+ intercept)`` equals demeaning
inside each month-of-year ``m``::

    b        = Σ (t - t̄ₘ)(y - ȳₘ) / Σ (t - t̄ₘ)²
    fitted   = ȳₘ + b (t - t̄ₘ)
    forecast = ȳₘ + b (t* - t̄ₘ)          (month seen in training)
             = mean over seen m of (ȳₘ - b t̄ₘ) + b t*   (unseen: minimum-norm fit)

``b`` is NULL when no month-of-year repeats (not identified).  Every step
runs on the monthly series (one row per month and group), so all windows and
joins here are over calendar-bounded tables; ``by`` adds group keys (K9: one
forecast per category) to every ``partitionBy`` and join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_start
from ..functions.numeric import money, ratio
from ..plans.scalars import attach_row
from ..session import checkpoint_dir


def monthly_series(sales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K1: revenue per month with position ``t`` (0, 1, … over months present).

    The fit, its diagnostics and the forecast each read the series several
    times; it is written once with a reliable checkpoint (one row per month
    and group), so ``sales`` is scanned once per forecast, not once per branch.
    """
    by = list(by)
    m = sales.groupBy(*by, month_start("order_date").alias("year_month")).agg(F.sum("cents").alias("cents"))
    w = Window.partitionBy(*by).orderBy("year_month")
    out = m.select(*by, "year_month", F.month("year_month").alias("month"),
                   (F.row_number().over(w) - 1).alias("t"), "cents", money("cents").alias("revenue"))
    checkpoint_dir(sales.sparkSession)
    return out.checkpoint(eager=True)


def month_dummies(series: DataFrame) -> DataFrame:
    """K2: the twelve 0/1 month indicators."""
    return series.select("year_month", "t", *[(F.col("month") == m).cast("int").alias(f"month_{m}")
                                              for m in range(1, 13)])


def month_means(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per (group, month-of-year): count, mean t, mean revenue (from exact sums)."""
    by = list(by)
    return series.groupBy(*by, "month").agg(
        F.count(F.lit(1)).alias("n_m"),
        (F.sum("t").cast("double") / F.count(F.lit(1)).cast("double")).alias("mean_t"),
        (F.sum("cents").cast("double") / F.count(F.lit(1)).cast("double") / F.lit(100.0)).alias("mean_y"))


def fit(series: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """K3: (month effects table, per-group slope table)."""
    by = list(by)
    mm = month_means(series, by)
    j = series.join(mm, by + ["month"])
    dt = F.col("t").cast("double") - F.col("mean_t")
    dy = F.col("revenue") - F.col("mean_y")
    sl = j.groupBy(*by).agg(F.sum(dt * dy).alias("sxy"), F.sum(dt * dt).alias("sxx"))
    sl = sl.select(*by, F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).alias("slope"))
    return mm, sl


def trend_seasonal_fit(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K3 report: slope and each month's effect ``ȳₘ - b t̄ₘ``."""
    by = list(by)
    mm, sl = fit(series, by)
    j = mm.join(sl, by) if by else attach_row(mm, sl)  # one row
    return j.select(*by, "month", F.col("n_m").alias("months"), "mean_t", "mean_y", "slope",
                    (F.col("mean_y") - F.col("slope") * F.col("mean_t")).alias("month_effect"))


def fitted_values(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K4: in-sample fitted values and residuals."""
    by = list(by)
    mm, sl = fit(series, by)
    j = series.join(mm, by + ["month"])
    j = j.join(sl, by) if by else attach_row(j, sl)
    fitted = F.col("mean_y") + F.col("slope") * (F.col("t").cast("double") - F.col("mean_t"))
    return j.select(*by, "year_month", "t", "revenue", fitted.alias("fitted")) \
            .withColumn("residual", F.col("revenue") - F.col("fitted"))


def diagnostics(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """K5: R² (``1 - SSR/SST``) and the residual std with ddof 0."""
    by = list(by)
    fv = fitted_values(series, by)
    ybar = series.groupBy(*by).agg((F.sum("cents").cast("double") / F.count(F.lit(1)).cast("double")
                                    / F.lit(100.0)).alias("ybar"))
    j = fv.join(ybar, by) if by else attach_row(fv, ybar)
    d = j.groupBy(*by).agg(F.sum(F.col("residual") * F.col("residual")).alias("ssr"),
                           F.sum((F.col("revenue") - F.col("ybar")) * (F.col("revenue") - F.col("ybar"))).alias("sst"),
                           F.count(F.lit(1)).alias("n"),
                           F.max("t").alias("last_t"), F.max("year_month").alias("last_month"))
    return d.select(*by, "n", "last_t", "last_month",
                    # a constant series fitted perfectly: R2 is 1 (no fit at all: 0)
                    F.when(F.col("sst") != 0, F.lit(1.0) - ratio(F.col("ssr"), F.col("sst")))
                    .otherwise((F.col("ssr") == 0).cast("double")).alias("r2"),
                    F.sqrt(F.col("ssr") / F.col("n").cast("double")).alias("resid_std"))


def forecast(series: DataFrame, horizon: int = 6, z: float = 1.96, by: Sequence[str] = ()) -> DataFrame:
    """K6 + K7: the next ``horizon`` months with a ``± z·σ`` band."""
    by = list(by)
    mm, sl = fit(series, by)
    dg = diagnostics(series, by)
    fut = dg.select(*by, "last_t", "last_month", "resid_std",  # one row per group
                    F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    fut = fut.select(*by, F.add_months("last_month", F.col("h")).alias("year_month"),
                     (F.col("last_t") + F.col("h")).alias("t"), "resid_std")
    fut = fut.withColumn("month", F.month("year_month"))
    fut = fut.join(sl, by) if by else attach_row(fut, sl)
    eff = mm.join(sl, by) if by else attach_row(mm, sl)
    seen_mean = eff.groupBy(*by).agg(F.avg(F.col("mean_y") - F.col("slope") * F.col("mean_t")).alias("a_bar"))
    j = fut.join(mm, by + ["month"], "left")
    j = j.join(seen_mean, by) if by else attach_row(j, seen_mean)
    tt = F.col("t").cast("double")
    fc = F.when(F.col("mean_y").isNotNull(), F.col("mean_y") + F.col("slope") * (tt - F.col("mean_t"))) \
          .otherwise(F.col("a_bar") + F.col("slope") * tt)
    return j.select(*by, "year_month", "t", fc.alias("forecast"), "resid_std")


def forecast_band(series: DataFrame, horizon: int = 6, z: float = 1.96, by: Sequence[str] = ()) -> DataFrame:
    """K7 for one or many series: forecast with ``lower`` / ``upper`` = ``∓ z·σ``."""
    by = list(by)
    f = forecast(series, horizon, z, by)
    band = F.lit(z) * F.col("resid_std")
    return f.select(*by, "year_month", "t", "forecast", (F.col("forecast") - band).alias("lower"),
                    (F.col("forecast") + band).alias("upper"))


def forecast_summary(series: DataFrame, horizon: int = 6, z: float = 1.96) -> DataFrame:
    """K5 + K8: one row — R², residual std, horizon, forecast total."""
    dg = diagnostics(series)
    tot = forecast(series, horizon, z).agg(F.sum("forecast").alias("forecast_total"))
    return attach_row(dg, tot).select(  # both one row
        "r2", "resid_std", F.lit(horizon).alias("horizon"), "forecast_total", "n", "last_month")
