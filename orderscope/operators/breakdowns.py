"""Breakdowns, shares, hierarchy and top-k.

All are one aggregation over ``sales`` (partial + final hash aggregate); the
share and parent lookups then run on the aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import money, ratio
from ..plans.lookups import checked
from ..plans.scalars import attach_row


def _aov(c: str = "c", n: str = "n"):
    return F.col(c).cast("double") / F.col(n).cast("double") / F.lit(100.0)


def revenue_by(sales: DataFrame, key: str) -> DataFrame:
    """total revenue per ``key``."""
    return sales.groupBy(key).agg(money(F.sum("cents")).alias("revenue"))


def channel_performance(sales: DataFrame, key: str = "channel") -> DataFrame:
    """revenue, orders and AOV per channel."""
    g = sales.groupBy(key).agg(F.sum("cents").alias("c"), F.count(F.lit(1)).alias("n"))
    return g.select(key, money("c").alias("revenue"), F.col("n").alias("orders"), _aov().alias("aov"))


def category_mix_by_year(sales: DataFrame) -> DataFrame:
    """each category's share of its year's revenue, in % (long form)."""
    g = sales.groupBy(F.year("order_date").alias("year"), "category").agg(F.sum("cents").alias("c"))
    tot = F.sum("c").over(Window.partitionBy("year"))  # over (year, category) rows only
    return g.select("year", "category", money("c").alias("revenue"),
                    (F.col("c").cast("double") / tot.cast("double") * F.lit(100.0)).alias("share_pct"))


def category_product_rollup(sales: DataFrame) -> DataFrame:
    """category -> product hierarchy with subtotals, total and % of parent.

    ``level`` is ``total`` / ``category`` / ``product``; the root has no parent
    (NULL share).
    """
    r = sales.rollup("category", "product").agg(F.sum("cents").alias("c"),
                                                F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 0, "product").when(F.col("gid") == 1, "category").otherwise("total")
    # the rollup rows (categories x products) are read three times below:
    # write them once so ``sales`` is scanned once
    r, _ = checked(r.withColumn("level", level))
    cat = r.where(F.col("gid") == 1).select(F.col("category").alias("pcat"), F.col("c").alias("pc"))
    tot = r.where(F.col("gid") == 3).select(F.col("c").alias("tc"))
    # null-safe: rows without a category have a parent too
    j = attach_row(r.join(cat, F.col("category").eqNullSafe(F.col("pcat")), "left"), tot)
    parent = F.when(F.col("gid") == 0, F.col("pc")).when(F.col("gid") == 1, F.col("tc"))
    return j.select("level", "category", "product", money("c").alias("revenue"),
                    (ratio(F.col("c").cast("double"), parent.cast("double")) * F.lit(100.0)).alias("pct_of_parent"))


def region_performance(sales: DataFrame) -> DataFrame:
    """revenue, orders, distinct customers and AOV per region."""
    g = sales.groupBy("region").agg(F.sum("cents").alias("c"), F.count(F.lit(1)).alias("n"),
                                    F.countDistinct("customer_id").alias("customers"))
    return g.select("region", money("c").alias("revenue"), F.col("n").alias("orders"), "customers",
                    _aov().alias("aov"))


def top_products(sales: DataFrame, n: int = 10) -> DataFrame:
    """the ``n`` best-selling products (``nlargest``; ties by name) with a tier.

    ``orderBy(...).limit(n)`` plans as a distributed top-k (each task keeps n
    rows); the rank window then runs over those ``n`` rows only.
    """
    g = sales.groupBy("product").agg(F.sum("cents").alias("c"))
    top = g.orderBy(F.desc("c"), F.asc("product")).limit(n)
    rk = F.row_number().over(Window.orderBy(F.desc("c"), F.asc("product")))
    t = top.withColumn("rank", rk)
    tier = F.when(F.col("rank") <= 3, "top3").when(F.col("rank") <= 6, "next3").otherwise("rest")
    return t.select("rank", "product", money("c").alias("revenue"), tier.alias("tier"))
