"""Quality reports and cleaning (on the dirty view where the branch must fire)."""

from __future__ import annotations

from ..operators import quality as Q
from ..oracles import money, q_quantiles, with_base
from ..registry import register
from ..sources.sales import FACT_COLUMNS, load_sales, sales_dirty, sales_raw

_FACT = ", ".join(FACT_COLUMNS)


def _qr_sql(view: str) -> str:
    any_null = " OR ".join(f"{c} IS NULL" for c in FACT_COLUMNS)
    return with_base(final=f"""
SELECT count(*) AS rows, count(*) - count(DISTINCT order_id) AS duplicate_keys,
       count(*) FILTER (WHERE unit_price IS NULL) AS null_prices,
       count(*) FILTER (WHERE {any_null}) AS rows_with_nulls
FROM {view}""")


@register("quality_report", group="quality", sql=_qr_sql("dirty"))
def q_quality_report(spark, sf):
    return Q.quality_report(sales_dirty(spark, sf))


@register("quality_report_raw", group="quality", sql=_qr_sql("raw"))
def q_quality_report_raw(spark, sf):
    return Q.quality_report(sales_raw(spark, sf))


@register("dedup_orders", group="quality", doubles=["unit_price", "revenue"],
          sql=with_base(final=f"""SELECT {_FACT}, revenue FROM raw QUALIFY row_number() OVER
  (PARTITION BY order_id ORDER BY tb_shipdate, tb_partkey, tb_suppkey, tb_quantity, tb_extendedprice) = 1"""))
def q_dedup_orders(spark, sf):
    d = Q.dedup_orders(sales_raw(spark, sf, with_tiebreak=True))
    return d.select(*FACT_COLUMNS, "revenue")


@register("category_median_price", group="quality", doubles=["median_price"],
          sql=with_base(final=q_quantiles("dclean_dd", "unit_price", [0.5], ["category"],
                                          ["median_price"], median=True)))
def q_category_median_price(spark, sf):
    d = Q.dedup_orders(sales_dirty(spark, sf))
    return Q.category_medians(d)


@register("impute_prices", group="quality", doubles=["unit_price", "revenue"],
          sql=with_base(final=f"SELECT {_FACT}, cents, {money('cents')} AS revenue FROM dclean_c"))
def q_impute_prices(spark, sf):
    return Q.impute_prices(Q.dedup_orders(sales_dirty(spark, sf)))


@register("clean_sales", group="quality", doubles=["unit_price", "revenue"],
          sql=with_base(final=f"SELECT {_FACT}, cents, revenue FROM dclean"))
def q_clean_sales(spark, sf):
    return Q.clean_sales(sales_dirty(spark, sf))


_CR_NULLS = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in FACT_COLUMNS + ["revenue"])


def _cr_sql(view: str) -> str:
    return with_base(final=f"""
SELECT count(*) AS rows, CAST({_CR_NULLS} AS BIGINT) AS nulls_remaining,
       min(order_date) AS min_date, max(order_date) AS max_date,
       count(DISTINCT customer_id) AS customers, count(DISTINCT product) AS products,
       {money('sum(cents)')} AS total_revenue
FROM {view}""")


@register("clean_report", group="quality", doubles=["total_revenue"], sql=_cr_sql("dclean"))
def q_clean_report(spark, sf):
    return Q.clean_report(Q.clean_sales(sales_dirty(spark, sf)))


@register("clean_report_sales", group="quality", doubles=["total_revenue"], sql=_cr_sql("sales"))
def q_clean_report_sales(spark, sf):
    return Q.clean_report(load_sales(spark, sf))


def describe_sql(rel: str, columns: list[str], scales: dict[str, int], digits: int = 2) -> list[tuple[str, str]]:
    """CTEs ``dl`` (long form) and the final describe SELECT text."""
    from ..oracles import D, lit, rhe
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS metric, {D(c)} AS value, "
        f"CAST(round_even({D(c)} * {lit(float(scales.get(c, 1)))}, 0) AS BIGINT) AS iv, "
        f"{lit(float(scales.get(c, 1)))} AS scale FROM {rel} WHERE {c} IS NOT NULL"
        for c in columns)
    q = q_quantiles("dl", "value", [0.25, 0.5, 0.75], ["metric"], ["p25", "p50", "p75"])
    agg = (f"SELECT metric, count(*) AS count, {D('sum(iv)')} / {D('count(*)')} / max(scale) AS mean, "
           f"stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM dl GROUP BY metric")
    r = lambda c: f"{rhe(c, digits)} AS {c}"
    final = (f"SELECT a.metric, a.count, {r('mean')}, {r('std')}, {r('min')}, {r('p25')}, {r('p50')}, "
             f"{r('p75')}, {r('max')} FROM ({agg}) a JOIN ({q}) q ON a.metric = q.metric")
    return [("dl", parts)], final


_DESC_COLS = ["quantity", "unit_price", "revenue"]
_DESC_SCALES = {"unit_price": 100, "revenue": 100}
_dctes, _dfinal = describe_sql("sales", _DESC_COLS, _DESC_SCALES)


@register("describe_numeric", group="quality",
          doubles=["mean", "std", "min", "p25", "p50", "p75", "max"],
          sql=with_base(*_dctes, final=_dfinal))
def q_describe_numeric(spark, sf):
    return Q.describe(load_sales(spark, sf), _DESC_COLS, _DESC_SCALES)
