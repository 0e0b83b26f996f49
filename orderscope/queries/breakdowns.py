"""Breakdowns, shares, rollup, top-k."""

from __future__ import annotations

from ..operators import breakdowns as B
from ..oracles import D, lit, money, with_base
from ..registry import register
from ..sources.sales import load_sales
from ._common import AOV, SUM_MONEY


@register("revenue_by_category", group="breakdowns", doubles=["revenue"],
          sql=with_base(final=f"SELECT category, {SUM_MONEY} AS revenue FROM sales GROUP BY 1"))
def q_revenue_by_category(spark, sf):
    return B.revenue_by(load_sales(spark, sf), "category")


@register("channel_performance", group="breakdowns", doubles=["revenue", "aov"],
          sql=with_base(final=f"SELECT channel, {SUM_MONEY} AS revenue, count(*) AS orders, {AOV} AS aov "
                              f"FROM sales GROUP BY 1"))
def q_channel_performance(spark, sf):
    return B.channel_performance(load_sales(spark, sf))


@register("category_mix_by_year", group="breakdowns", doubles=["revenue", "share_pct"], sql=with_base(
    ("g", "SELECT CAST(year(order_date) AS INTEGER) AS year, category, sum(cents) AS c FROM sales GROUP BY 1, 2"),
    final=f"SELECT year, category, {money('c')} AS revenue, "
          f"{D('c')} / {D('sum(c) OVER (PARTITION BY year)')} * {lit(100.0)} AS share_pct FROM g"))
def q_category_mix_by_year(spark, sf):
    return B.category_mix_by_year(load_sales(spark, sf))


@register("category_product_rollup", group="breakdowns", doubles=["revenue", "pct_of_parent"], sql=with_base(
    ("r", "SELECT category, product, sum(cents) AS c, grouping(category, product) AS gid "
          "FROM sales GROUP BY ROLLUP (category, product)"),
    final=f"""SELECT CASE WHEN r.gid = 0 THEN 'product' WHEN r.gid = 1 THEN 'category' ELSE 'total' END AS level,
       r.category, r.product, {money('r.c')} AS revenue,
       {D('r.c')} / {D('CASE WHEN r.gid = 0 THEN p.c WHEN r.gid = 1 THEN t.c END')} * {lit(100.0)} AS pct_of_parent
FROM r LEFT JOIN (SELECT category, c FROM r WHERE gid = 1) p ON r.category IS NOT DISTINCT FROM p.category
CROSS JOIN (SELECT c FROM r WHERE gid = 3) t"""))
def q_category_product_rollup(spark, sf):
    return B.category_product_rollup(load_sales(spark, sf))


@register("region_performance", group="breakdowns", doubles=["revenue", "aov"],
          sql=with_base(final=f"SELECT region, {SUM_MONEY} AS revenue, count(*) AS orders, "
                              f"count(DISTINCT customer_id) AS customers, {AOV} AS aov FROM sales GROUP BY 1"))
def q_region_performance(spark, sf):
    return B.region_performance(load_sales(spark, sf))


def _top_sql(n: int) -> str:
    return with_base(
        ("g", "SELECT product, sum(cents) AS c FROM sales GROUP BY 1"),
        ("t", f"SELECT product, c, CAST(row_number() OVER (ORDER BY c DESC, product) AS INTEGER) AS rank FROM g"),
        final=f"SELECT rank, product, {money('c')} AS revenue, CASE WHEN rank <= 3 THEN 'top3' "
              f"WHEN rank <= 6 THEN 'next3' ELSE 'rest' END AS tier FROM t WHERE rank <= {n}")


@register("top_products", group="breakdowns", doubles=["revenue"], sql=_top_sql(10))
def q_top_products(spark, sf):
    return B.top_products(load_sales(spark, sf), 10)


@register("top_products_dashboard", group="breakdowns", doubles=["revenue"], sql=_top_sql(12))
def q_top_products_dashboard(spark, sf):
    return B.top_products(load_sales(spark, sf), 12)
