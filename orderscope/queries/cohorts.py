"""Cohorts and retention."""

from __future__ import annotations

from ..operators import cohorts as C
from ..oracles import D, lit, rhe, with_base
from ..registry import register
from ..sources.sales import load_sales
from ._common import MONTH

CTES = [
    ("cm", f"SELECT DISTINCT customer_id, {MONTH} AS year_month FROM sales"),
    ("first", "SELECT customer_id, min(year_month) AS cohort_month FROM cm GROUP BY 1"),
    ("act", """SELECT cm.customer_id, cm.year_month, f.cohort_month,
        CAST((year(cm.year_month) - year(f.cohort_month)) * 12 + (month(cm.year_month) - month(f.cohort_month))
             AS INTEGER) AS cohort_index
        FROM cm JOIN first f ON cm.customer_id = f.customer_id"""),
    ("counts", "SELECT cohort_month, cohort_index, count(*) AS customers FROM act GROUP BY 1, 2"),
    ("ret", f"""SELECT c.cohort_month, c.cohort_index, c.customers, s.customers AS cohort_size,
        {rhe(f"{D('c.customers')} / {D('s.customers')}", 3)} AS retention
        FROM counts c JOIN (SELECT cohort_month, customers FROM counts WHERE cohort_index = 0) s
        ON c.cohort_month = s.cohort_month"""),
    ("curve", f"""SELECT cohort_index, CAST(row_number() OVER (ORDER BY cohort_index) - 1 AS INTEGER) AS position,
        count(*) AS cohorts,
        {D('sum(CAST(round_even(retention * 1000.0::DOUBLE, 0) AS BIGINT))')} / {D('count(*)')}
          / {lit(1000.0)} * {lit(100.0)} AS avg_retention_pct
        FROM ret GROUP BY cohort_index"""),
]


def _counts(spark, sf):
    return C.cohort_counts(load_sales(spark, sf))


@register("cohort_assignment", group="cohorts", sql=with_base(*CTES, final="SELECT * FROM first"))
def q_cohort_assignment(spark, sf):
    return C.cohort_assignment(load_sales(spark, sf))


@register("cohort_activity", group="cohorts", sql=with_base(*CTES, final="SELECT * FROM act"))
def q_cohort_activity(spark, sf):
    """I2 + I3: active (customer, month) pairs with their cohort and age."""
    return C.cohort_activity(load_sales(spark, sf))


@register("cohort_counts", group="cohorts", sql=with_base(*CTES, final="SELECT * FROM counts"))
def q_cohort_counts(spark, sf):
    return _counts(spark, sf)


@register("retention_grid", group="cohorts", sql=with_base(*CTES, final="""
SELECT cohort_month, string_agg(cohort_index || ':' || customers, ',' ORDER BY cohort_index) AS customers_by_age
FROM counts GROUP BY cohort_month"""))
def q_retention_grid(spark, sf):
    return C.retention_grid(_counts(spark, sf))


@register("retention_heatmap", group="cohorts", doubles=[f"age_{i}" for i in range(13)],
          sql=with_base(*CTES, final="SELECT cohort_month, " + ", ".join(
              f"max(CASE WHEN cohort_index = {i} THEN retention END) AS age_{i}" for i in range(13))
              + " FROM ret WHERE cohort_index < 13 GROUP BY cohort_month"))
def q_retention_heatmap(spark, sf):
    return C.retention_heatmap(C.cohort_retention(_counts(spark, sf)))


@register("cohort_retention", group="cohorts", doubles=["retention"],
          sql=with_base(*CTES, final="SELECT * FROM ret"))
def q_cohort_retention(spark, sf):
    return C.cohort_retention(_counts(spark, sf))


@register("retention_curve", group="cohorts", doubles=["avg_retention_pct"],
          sql=with_base(*CTES, final="SELECT * FROM curve"))
def q_retention_curve(spark, sf):
    return C.retention_curve(C.cohort_retention(_counts(spark, sf)))


@register("retention_milestones", group="cohorts", doubles=["avg_retention_pct"],
          sql=with_base(*CTES, final="SELECT * FROM curve WHERE position IN (1, 3, 6, 12)"))
def q_retention_milestones(spark, sf):
    return C.retention_milestones(C.retention_curve(C.cohort_retention(_counts(spark, sf))))
