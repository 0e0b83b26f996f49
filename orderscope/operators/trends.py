"""Monthly trends, rolling and growth windows, pivots.

Every window here runs *after* the monthly aggregation, over one row per month
(bounded by the calendar span, not by the data), so an un-partitioned window
is a single small task.  No window is ever applied to ``sales`` itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import MONTH_ABBR, WEEKDAYS, day_name, in_years, month_start
from ..functions.numeric import money, ratio


def aov(cents_sum: str, n: str):
    """Average order value from summed cents and a row count: ``sum / n / 100``."""
    return F.col(cents_sum).cast("double") / F.col(n).cast("double") / F.lit(100.0)


def monthly_sales(sales: DataFrame) -> DataFrame:
    """Revenue, orders, distinct customers and AOV per month."""
    m = sales.groupBy(month_start("order_date").alias("year_month")).agg(
        F.sum("cents").alias("cents"),
        F.count(F.lit(1)).alias("orders"),
        F.countDistinct("customer_id").alias("customers"))
    return m.select("year_month", money("cents").alias("revenue"), "orders", "customers",
                    aov("cents", "orders").alias("aov"))


def monthly_cents(sales: DataFrame) -> DataFrame:
    """Month -> summed cents (the series used by windows and the forecast)."""
    return sales.groupBy(month_start("order_date").alias("year_month")) \
                .agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("orders"))


def rolling_mean(monthly: DataFrame, window: int = 3, min_periods: int | None = None,
                 out: str = "rolling_revenue", order: str = "year_month") -> DataFrame:
    """Pandas ``rolling(window, min_periods).mean()`` over positional months.

    ``min_periods`` defaults to ``window`` (strict: NULL until enough rows).
    Summation is over exact cents.
    """
    min_periods = window if min_periods is None else min_periods
    w = Window.orderBy(order).rowsBetween(-(window - 1), 0)
    n = F.count(F.lit(1)).over(w)
    mean = F.sum("cents").over(w).cast("double") / n.cast("double") / F.lit(100.0)
    return monthly.withColumn(out, F.when(n >= F.lit(min_periods), mean))


def rolling_revenue(sales: DataFrame, window: int = 3) -> DataFrame:
    m = monthly_cents(sales)
    return rolling_mean(m, window).select("year_month", money("cents").alias("revenue"),
                                          "rolling_revenue")


def of_years(sales: DataFrame, *years: int) -> DataFrame:
    """The rows of the given years: a date range, and the partition column where there is one."""
    cond = in_years("order_date", *years)
    if "order_year" in sales.columns:
        cond = F.col("order_year").isin(*years) & cond
    return sales.where(cond)


def revenue_trend(sales: DataFrame, category: str | None = None, year: int | None = None,
                  window: int = 3, min_periods: int = 1) -> DataFrame:
    """The dashboard's filtered trend (filters push down to the scan side)."""
    df = sales
    if category not in (None, "All"):
        df = df.where(F.col("category") == F.lit(category))
    if year not in (None, "All"):
        df = of_years(df, int(year))
    m = monthly_cents(df)
    return rolling_mean(m, window, min_periods).select(
        "year_month", money("cents").alias("revenue"), "rolling_revenue")


def mom_growth(sales: DataFrame) -> DataFrame:
    """``pct_change() * 100`` (positional) and a direction flag.

    A zero previous month gives NULL (the reference gives inf).
    """
    m = monthly_cents(sales).withColumn("revenue", money("cents"))
    prev = F.lag("revenue", 1).over(Window.orderBy("year_month"))
    g = (ratio(F.col("revenue"), prev) - F.lit(1.0)) * F.lit(100.0)
    return m.select("year_month", "revenue", g.alias("mom_growth_pct")).withColumn(
        "direction", F.when(F.col("mom_growth_pct") >= 0, F.lit("up"))
                      .when(F.col("mom_growth_pct") < 0, F.lit("down")))


def yoy_growth(sales: DataFrame, year_a: int, year_b: int) -> DataFrame:
    """E5: revenue of two years and the growth of ``year_b`` over ``year_a`` in %."""
    y = F.year("order_date")
    t = of_years(sales, year_a, year_b).agg(
        F.sum(F.when(y == year_a, F.col("cents")).otherwise(F.lit(0))).alias("ca"),
        F.sum(F.when(y == year_b, F.col("cents")).otherwise(F.lit(0))).alias("cb"))
    ra, rb = money(F.coalesce("ca", F.lit(0))), money(F.coalesce("cb", F.lit(0)))
    return t.select(F.lit(year_a).alias("year_a"), F.lit(year_b).alias("year_b"),
                    ra.alias("revenue_a"), rb.alias("revenue_b"),
                    (ratio(rb - ra, ra) * F.lit(100.0)).alias("yoy_pct"))


def seasonality_by_year(sales: DataFrame) -> DataFrame:
    """Revenue of every (year, month) that has sales, in long form."""
    g = sales.groupBy(F.year("order_date").alias("year"), F.month("order_date").alias("month")).agg(
        F.sum("cents").alias("cents"))
    return g.select("year", "month", money("cents").alias("revenue"))


def seasonality_grid(sales: DataFrame, years: Sequence[int]) -> DataFrame:
    """A wide view of E6 for the years given: ``revenue_<year>`` columns, NULL when empty."""
    y = [int(v) for v in years]
    base = of_years(sales, *y).select(F.month("order_date").alias("month"), F.year("order_date").alias("year"), "cents")
    p = base.groupBy("month").pivot("year", y).agg(F.sum("cents"))
    return p.select("month", *[money(F.col(str(v))).alias(f"revenue_{v}") for v in y])


def week_weekday_heatmap(sales: DataFrame) -> DataFrame:
    """ISO week (across years) x weekday revenue grid, Monday-first columns."""
    base = sales.select(F.weekofyear("order_date").alias("week"),
                        day_name("order_date").alias("dow"), "cents")
    p = base.groupBy("week").pivot("dow", WEEKDAYS).agg(F.sum("cents"))
    return p.select("week", *[money(F.col(d)).alias(d) for d in WEEKDAYS])


def weekday_month_aov(sales: DataFrame) -> DataFrame:
    """Weekday x month AOV grid (rows Monday..Sunday, columns Jan..Dec).

    All seven weekdays are present as rows (``reindex``), NULL when a weekday
    has no orders at all.
    """
    m = F.month("order_date")
    g = sales.groupBy(day_name("order_date").alias("day_of_week")).agg(
        *[F.sum(F.when(m == i + 1, F.col("cents"))).alias(f"s{i}") for i in range(12)],
        *[F.count(F.when(m == i + 1, F.lit(1))).alias(f"n{i}") for i in range(12)])
    days = sales.sparkSession.createDataFrame([(d, i) for i, d in enumerate(WEEKDAYS)],
                                              "day_of_week string, dow_index int")
    j = days.join(F.broadcast(g), "day_of_week", "left")  # g: one row per weekday (<= 7)
    cols = [F.when(F.col(f"n{i}") > 0, F.col(f"s{i}").cast("double") / F.col(f"n{i}").cast("double")
                   / F.lit(100.0)).alias(MONTH_ABBR[i]) for i in range(12)]
    return j.select("day_of_week", "dow_index", *cols)
