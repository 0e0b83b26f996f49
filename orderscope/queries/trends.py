"""Monthly trends, windows and pivots."""

from __future__ import annotations

from ..functions.dates import MONTH_ABBR, WEEKDAYS
from ..operators import trends as T
from ..oracles import D, lit, money, with_base
from ..registry import register
from ..sources.sales import ROLES, load_sales
from ._common import AOV, MONTH, SUM_MONEY

TREND_CATEGORY = "ECONOMY"   # dashboard filter values used by the registered E3 query
TREND_YEAR = ROLES.year_b


@register("monthly_sales", group="trends", doubles=["revenue", "aov"], sql=with_base(final=f"""
SELECT {MONTH} AS year_month, {SUM_MONEY} AS revenue, count(*) AS orders,
       count(DISTINCT customer_id) AS customers, {AOV} AS aov
FROM sales GROUP BY 1"""))
def q_monthly_sales(spark, sf):
    return T.monthly_sales(load_sales(spark, sf))


def _rolling_sql(where: str, min_periods: int) -> str:
    return with_base(
        ("m", f"SELECT {MONTH} AS year_month, sum(cents) AS cents FROM sales {where} GROUP BY 1"),
        final=f"""
SELECT year_month, {money('cents')} AS revenue,
       CASE WHEN count(*) OVER w >= {min_periods}
            THEN {D('sum(cents) OVER w')} / {D('count(*) OVER w')} / {lit(100.0)} END AS rolling_revenue
FROM m WINDOW w AS (ORDER BY year_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")


@register("rolling_revenue", group="trends", doubles=["revenue", "rolling_revenue"],
          sql=_rolling_sql("", 3))
def q_rolling_revenue(spark, sf):
    return T.rolling_revenue(load_sales(spark, sf))


@register("revenue_trend_filtered", group="trends", doubles=["revenue", "rolling_revenue"],
          sql=_rolling_sql(f"WHERE category = '{TREND_CATEGORY}' AND year(order_date) = {TREND_YEAR}", 1))
def q_revenue_trend_filtered(spark, sf):
    return T.revenue_trend(load_sales(spark, sf), TREND_CATEGORY, TREND_YEAR)


@register("revenue_trend_all", group="trends", doubles=["revenue", "rolling_revenue"],
          sql=_rolling_sql("", 1))
def q_revenue_trend_all(spark, sf):
    return T.revenue_trend(load_sales(spark, sf), "All", "All")


@register("mom_growth", group="trends", doubles=["revenue", "mom_growth_pct"], sql=with_base(
    ("m", f"SELECT {MONTH} AS year_month, {SUM_MONEY} AS revenue FROM sales GROUP BY 1"),
    ("g", f"""SELECT year_month, revenue,
       (revenue / NULLIF(lag(revenue) OVER (ORDER BY year_month), {lit(0.0)}) - {lit(1.0)}) * {lit(100.0)}
         AS mom_growth_pct FROM m"""),
    final="""SELECT *, CASE WHEN mom_growth_pct >= 0 THEN 'up' WHEN mom_growth_pct < 0 THEN 'down' END
       AS direction FROM g"""))
def q_mom_growth(spark, sf):
    return T.mom_growth(load_sales(spark, sf))


_A, _B = ROLES.year_a, ROLES.year_b


@register("yoy_growth", group="trends", doubles=["revenue_a", "revenue_b", "yoy_pct"], sql=with_base(
    ("t", f"""SELECT {money(f'coalesce(sum(CASE WHEN year(order_date) = {_A} THEN cents ELSE 0 END), 0)')} AS ra,
                     {money(f'coalesce(sum(CASE WHEN year(order_date) = {_B} THEN cents ELSE 0 END), 0)')} AS rb
              FROM sales WHERE year(order_date) IN ({_A}, {_B})"""),
    final=f"""SELECT {_A} AS year_a, {_B} AS year_b, ra AS revenue_a, rb AS revenue_b,
       (rb - ra) / NULLIF(ra, {lit(0.0)}) * {lit(100.0)} AS yoy_pct FROM t"""))
def q_yoy_growth(spark, sf):
    return T.yoy_growth(load_sales(spark, sf), ROLES.year_a, ROLES.year_b)


@register("seasonality_by_year", group="trends", doubles=["revenue"], sql=with_base(final=f"""
SELECT CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month,
       {money('sum(cents)')} AS revenue
FROM sales GROUP BY 1, 2"""))
def q_seasonality_by_year(spark, sf):
    return T.seasonality_by_year(load_sales(spark, sf))


@register("seasonality_grid", group="trends", doubles=[f"revenue_{_A}", f"revenue_{_B}"],
          sql=with_base(final=f"""
SELECT CAST(month(order_date) AS INTEGER) AS month,
       {money(f'sum(CASE WHEN year(order_date) = {_A} THEN cents END)')} AS revenue_{_A},
       {money(f'sum(CASE WHEN year(order_date) = {_B} THEN cents END)')} AS revenue_{_B}
FROM sales WHERE year(order_date) IN ({_A}, {_B}) GROUP BY 1"""))
def q_seasonality_grid(spark, sf):
    return T.seasonality_grid(load_sales(spark, sf), [ROLES.year_a, ROLES.year_b])


@register("week_weekday_heatmap", group="trends", doubles=WEEKDAYS, sql=with_base(final=f"""
SELECT CAST(week(order_date) AS INTEGER) AS week,
       {', '.join(money(f"sum(CASE WHEN dayname(order_date) = '{d}' THEN cents END)") + f' AS {d}'
                  for d in WEEKDAYS)}
FROM sales GROUP BY 1"""))
def q_week_weekday_heatmap(spark, sf):
    return T.week_weekday_heatmap(load_sales(spark, sf))


_DAYS = " UNION ALL ".join(f"SELECT '{d}' AS day_of_week, {i} AS dow_index" for i, d in enumerate(WEEKDAYS))


@register("weekday_month_aov", group="trends", doubles=MONTH_ABBR, sql=with_base(
    ("days", _DAYS),
    ("g", f"""SELECT dayname(order_date) AS day_of_week,
       {', '.join(f'sum(CASE WHEN month(order_date) = {i + 1} THEN cents END) AS s{i}, '
                  f'count(CASE WHEN month(order_date) = {i + 1} THEN 1 END) AS n{i}' for i in range(12))}
       FROM sales GROUP BY 1"""),
    final=f"""SELECT d.day_of_week, CAST(d.dow_index AS INTEGER) AS dow_index,
       {', '.join(f'CASE WHEN n{i} > 0 THEN {D(f"s{i}")} / {D(f"n{i}")} / {lit(100.0)} END AS {MONTH_ABBR[i]}'
                  for i in range(12))}
FROM days d LEFT JOIN g ON d.day_of_week = g.day_of_week"""))
def q_weekday_month_aov(spark, sf):
    return T.weekday_month_aov(load_sales(spark, sf))
