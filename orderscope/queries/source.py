"""A1–A2 sources and C1–C8 calendar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import time_features
from ..oracles import with_base
from ..registry import register
from ..sources.sales import FACT_COLUMNS, TIEBREAK, load_sales, sales_preview, sales_raw

_RAW_COLS = ", ".join(FACT_COLUMNS + ["revenue"])


@register("sales_raw", group="source", doubles=["unit_price", "revenue"],
          sql=with_base(final=f"SELECT {_RAW_COLS} FROM raw"))
def q_sales_raw(spark, sf):
    return sales_raw(spark, sf)


@register("preview", group="source", doubles=["unit_price", "revenue"], sql=with_base(final=f"""
SELECT {_RAW_COLS} FROM raw ORDER BY order_date, order_id, {', '.join(TIEBREAK)} LIMIT 5"""))
def q_preview(spark, sf):
    """A2: first five raw rows by date (the limit is the feature)."""
    return sales_preview(spark, sf, 5)


@register("time_features", group="source", sql=with_base(final="""
SELECT order_id, CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month,
       strftime(order_date, '%b') AS month_name,
       CAST(year(order_date) AS VARCHAR) || 'Q' || CAST(quarter(order_date) AS VARCHAR) AS quarter,
       CAST(week(order_date) AS INTEGER) AS week, dayname(order_date) AS day_of_week,
       CAST(date_trunc('month', order_date) AS DATE) AS year_month,
       isodow(order_date) >= 6 AS is_weekend
FROM sales"""))
def q_time_features(spark, sf):
    s = load_sales(spark, sf).select("order_id", "order_date")
    return time_features(s).drop("order_date")


@register("filter_values", group="source", sql=with_base(final="""
SELECT 'category' AS kind, category AS value FROM (SELECT DISTINCT category FROM sales)
UNION ALL
SELECT 'year' AS kind, CAST(y AS VARCHAR) AS value FROM (SELECT DISTINCT year(order_date) AS y FROM sales)"""))
def q_filter_values(spark, sf):
    """the dashboard's filter choices (distinct categories and years)."""
    s = load_sales(spark, sf)
    # one scan: each row emits its (kind, value) pairs; the distinct is a
    # partial aggregation, so repeated values collapse before the shuffle
    pairs = F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
                    F.struct(F.lit("year").alias("kind"), F.year("order_date").cast("string").alias("value")))
    return s.select(F.explode(pairs).alias("p")).select("p.kind", "p.value").distinct()
