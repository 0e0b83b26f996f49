"""Data-quality reports, cleaning and numeric description.

The cleaning steps themselves (dedup, imputation, revenue recompute, filter)
live in :mod:`orderscope.sources.sales`, because the ``sales`` source is built
with them; this module re-exports them and adds the reports.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import dec, exact_double, money, ratio, round_half_even
from ..plans.quantiles import quantiles, value_counts
from ..plans.scalars import attach_row
from ..sources.sales import (FACT_COLUMNS, TIEBREAK, category_medians, clean_sales,  # noqa: F401
                             dedup_keep_first, impute_prices)


def quality_report(df: DataFrame, key: str = "order_id", value: str = "unit_price",
                   columns: Sequence[str] = tuple(FACT_COLUMNS)) -> DataFrame:
    """B1: rows, duplicate keys, NULL ``value`` rows and rows with any NULL (one row)."""
    any_null = F.lit(False)
    for c in columns:
        any_null = any_null | F.col(c).isNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - F.countDistinct(key)).alias("duplicate_keys"),
        F.count_if(F.col(value).isNull()).alias("null_prices"),
        F.count_if(any_null).alias("rows_with_nulls"))


def dedup_orders(df: DataFrame, key: str = "order_id") -> DataFrame:
    """B2: keep the first row per key (total order: the line's own columns)."""
    order = [c for c in TIEBREAK if c in df.columns] or ["order_date"]
    return dedup_keep_first(df, [key], order)


def clean_report(clean: DataFrame) -> DataFrame:
    """Rows, NULL cells left, date range, distinct customers/products, revenue."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in FACT_COLUMNS + ["revenue"]), F.lit(0))
    out = clean.agg(
        F.count(F.lit(1)).alias("rows"),
        nulls.cast("bigint").alias("nulls_remaining"),
        F.min("order_date").alias("min_date"),
        F.max("order_date").alias("max_date"),
        money(F.sum("cents")).alias("total_revenue"))
    # each distinct count reads its own column: several in one aggregate would
    # multiply every row by an Expand
    for column, name in (("customer_id", "customers"), ("product", "products")):
        out = attach_row(out, clean.agg(F.countDistinct(column).alias(name)))
    return out.select("rows", "nulls_remaining", "min_date", "max_date", "customers", "products", "total_revenue")


# describe() rows reported by the reference, in its order.
DESCRIBE_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def describe(df: DataFrame, columns: Sequence[str], scales: dict[str, int] | None = None,
             digits: int = 2) -> DataFrame:
    """Pandas ``describe().round(digits)`` in long form, one row per column.

    ``scales`` gives columns whose values are exact multiples of ``1/scale``
    (money: 100), other columns hold integers; mean and sample deviation come from
    exact integer sums, quantiles from the distributed exact plan, and all of them
    from one table of distinct values with their counts.
    """
    scales = scales or {}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("m")).select("m.*")
    vc = value_counts(long, "value", ["metric"])  # one scan; all that follows reads it
    scale = F.element_at(F.create_map(*[F.lit(x) for c in columns for x in (c, float(scales.get(c, 1)))]), F.col("metric"))
    iv = dec(F.rint(F.col("v") * scale).cast("bigint"))
    agg = vc.groupBy("metric").agg(
        F.sum("c").alias("count"), F.sum((dec("c") * iv).cast("decimal(38,0)")).alias("s"),
        F.sum((dec("c") * (iv * iv).cast("decimal(38,0)")).cast("decimal(38,0)")).alias("ss"),
        F.min("v").alias("min"), F.max("v").alias("max")).withColumn("scale", scale)
    n = F.col("count").cast("double")
    var = ratio(exact_double(dec("count") * F.col("ss") - F.col("s") * F.col("s")), n * (n - F.lit(1.0)))
    agg = agg.select("metric", "count", (F.col("s").cast("double") / n / F.col("scale")).alias("mean"),
                     (F.sqrt(var) / F.col("scale")).alias("std"), "min", "max")
    q = quantiles(None, "value", [0.25, 0.5, 0.75], ["metric"], out=["p25", "p50", "p75"], counts=vc)
    out = agg.join(q, "metric")
    r = lambda c: round_half_even(F.col(c), digits).alias(c)
    return out.select("metric", "count", r("mean"), r("std"), r("min"), r("p25"), r("p50"),
                      r("p75"), r("max"))
