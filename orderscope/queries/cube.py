"""E3 and F7 from the written cube: what the dashboard's two filters show."""

from __future__ import annotations

from ..operators import cube as C
from ..oracles import D, lit, money, with_base
from ..registry import register
from ..sources.sales import derived
from ._common import MONTH
from .trends import TREND_CATEGORY, TREND_YEAR


def _cube(spark, sf):
    return derived(spark, sf, "cube-1", C.sales_cube)


def _choice(category: str, year: str) -> str:
    """The months of all choices of one kind, straight from the orders."""
    return (f"SELECT {category} AS category_choice, {year} AS year_choice, {MONTH} AS year_month, "
            f"sum(cents) AS cents, count(*) AS orders FROM sales GROUP BY 1, 2, 3")


_YEAR = "CAST(year(order_date) AS VARCHAR)"
_MEAN = f"{D('sum(cents) OVER w')} / {D('count(*) OVER w')} / {lit(100.0)}"


@register("trend_every_filter", group="cube", doubles=["revenue", "rolling_revenue"], sql=with_base(
    ("m", " UNION ALL ".join(_choice(c, y) for c in ("'All'", "category") for y in ("'All'", _YEAR))),
    final=f"""
SELECT category_choice, year_choice, year_month, {money('cents')} AS revenue, CAST(orders AS BIGINT) AS orders,
       {_MEAN} AS rolling_revenue
FROM m WINDOW w AS (PARTITION BY category_choice, year_choice ORDER BY year_month
                    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""))
def q_trend_every_filter(spark, sf):
    return C.every_trend(_cube(spark, sf))


@register("trend_filtered_cube", group="cube", doubles=["revenue", "rolling_revenue"], sql=with_base(
    ("m", f"""SELECT {MONTH} AS year_month, sum(cents) AS cents FROM sales
              WHERE category = '{TREND_CATEGORY}' AND year(order_date) = {TREND_YEAR} GROUP BY 1"""),
    final=f"""
SELECT year_month, {money('cents')} AS revenue, {_MEAN} AS rolling_revenue
FROM m WINDOW w AS (ORDER BY year_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""))
def q_trend_filtered_cube(spark, sf):
    return C.trend_of(_cube(spark, sf), TREND_CATEGORY, TREND_YEAR)


@register("filter_values_cube", group="cube", sql=with_base(final="""
SELECT 'category' AS kind, category AS value FROM (SELECT DISTINCT category FROM sales)
UNION ALL
SELECT 'year' AS kind, CAST(y AS VARCHAR) AS value FROM (SELECT DISTINCT year(order_date) AS y FROM sales)"""))
def q_filter_values_cube(spark, sf):
    return C.choices(_cube(spark, sf))
