"""The dashboard's live filters from one small written table.

``sales_cube`` has a row per (category, year, month) that has sales: its size follows the
catalogue and the calendar, not the number of orders.  It is made once per snapshot of
``sales``; after that no choice of the two filters reads an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_start
from ..functions.numeric import money
from .trends import rolling_mean

#: Fixed value: the choice that filters nothing.
ALL = "All"


def sales_cube(sales: DataFrame) -> DataFrame:
    """Cents and orders of every category, year and month with sales (a partial aggregation)."""
    return sales.groupBy("category", F.year("order_date").alias("year"), month_start("order_date").alias("year_month")).agg(
        F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("orders"))


def trend_of(cube: DataFrame, category: str | None = None, year: int | str | None = None,
             window: int = 3, min_periods: int = 1) -> DataFrame:
    """E3 for one choice of both filters: monthly revenue and its rolling mean (months
    without sales of the choice are no rows, as in :func:`~.trends.revenue_trend`)."""
    if category not in (None, ALL):
        cube = cube.where(F.col("category") == F.lit(category))
    if year not in (None, ALL):
        cube = cube.where(F.col("year") == F.lit(int(year)))
    months = cube.groupBy("year_month").agg(F.sum("cents").alias("cents"))
    return rolling_mean(months, window, min_periods).select("year_month", money("cents").alias("revenue"), "rolling_revenue")


def every_trend(cube: DataFrame, window: int = 3) -> DataFrame:
    """E3 for every choice of both filters, ``All`` included: one pass over the cube in
    four grouping sets, then a window per choice (as many rows as the choice has months).
    Orders without a category count under ``All`` and as the choice NULL."""
    cat, year, month = F.col("category"), F.col("year"), F.col("year_month")
    sets = cube.groupingSets([[cat, year, month], [cat, month], [year, month], [month]], cat, year, month).agg(
        F.sum("cents").alias("cents"), F.sum("orders").alias("orders"),
        F.grouping("category").alias("all_categories"), F.grouping("year").alias("all_years"))
    w = Window.partitionBy("all_categories", "category", "all_years", "year").orderBy("year_month") \
              .rowsBetween(-(window - 1), 0)
    mean = F.sum("cents").over(w).cast("double") / F.count(F.lit(1)).over(w).cast("double") / F.lit(100.0)
    return sets.select(
        F.when(F.col("all_categories") == 1, F.lit(ALL)).otherwise(cat).alias("category_choice"),
        F.when(F.col("all_years") == 1, F.lit(ALL)).otherwise(year.cast("string")).alias("year_choice"),
        "year_month", money("cents").alias("revenue"), "orders", mean.alias("rolling_revenue"))


def choices(cube: DataFrame) -> DataFrame:
    """the values that the two filters offer."""
    pairs = F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
                    F.struct(F.lit("year").alias("kind"), F.col("year").cast("string").alias("value")))
    return cube.select(F.explode(pairs).alias("p")).select("p.kind", "p.value").distinct()
