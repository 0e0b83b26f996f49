"""L1–L2: KPI rows (segments from the seed-centroid path so SQL can check them)."""

from __future__ import annotations

from ..operators import kpis as L
from ..oracles import D, lit, with_base
from ..registry import register
from ..sources.sales import ROLES
from .cohorts import CTES as COHORT_CTES
from .forecast import CT as FC_CTES
from .segments import SEG_CTES, _SC, _seg, summary_sql

_A, _B = ROLES.year_a, ROLES.year_b
_CHAMP_CENTS = ("coalesce(sum(CAST(round_even(monetary * 100.0::DOUBLE, 0) AS BIGINT)) "
                "FILTER (WHERE segment = 'Champions'), 0)")
_CTES = SEG_CTES + COHORT_CTES + FC_CTES + [
    ("tt", f"SELECT {D('sum(cents)')} / {lit(100.0)} AS total_revenue, count(DISTINCT customer_id) AS customers, "
           f"{D('sum(cents)')} / {D('count(*)')} / {lit(100.0)} AS aov FROM sales"),
    ("yt", f"SELECT coalesce(sum(CASE WHEN year(order_date) = {_A} THEN cents END), 0) AS ca, "
           f"coalesce(sum(CASE WHEN year(order_date) = {_B} THEN cents END), 0) AS cb "
           f"FROM sales WHERE year(order_date) IN ({_A}, {_B})"),
    ("ch", f"SELECT count(*) FILTER (WHERE segment = 'Champions') AS champion_customers, "
           f"{D(_CHAMP_CENTS)} / {D(_SC)} * {lit(100.0)} AS champions_share_pct FROM seg"),
    ("fct", "SELECT sum(forecast) AS forecast_total FROM fc"),
    ("ssum", summary_sql()),
]


def _sales_seg(spark, sf):
    from ..sources.sales import load_sales
    return load_sales(spark, sf), _seg(spark, sf)


@register("overview_kpis", group="kpis",
          doubles=["total_revenue", "yoy_pct", "aov", "champions_share_pct", "forecast_total"],
          sql=with_base(*_CTES, final=f"""
SELECT tt.total_revenue, {D('yt.cb - yt.ca')} / {D('yt.ca')} * {lit(100.0)} AS yoy_pct, tt.customers, tt.aov,
       ch.champions_share_pct, fct.forecast_total FROM tt, yt, ch, fct"""))
def q_overview_kpis(spark, sf):
    s, seg = _sales_seg(spark, sf)
    return L.overview_kpis(s, seg, ROLES.year_a, ROLES.year_b)


@register("project_summary", group="kpis",
          doubles=["total_revenue", "yoy_pct", "month1_retention_pct", "champion_share_pct", "forecast_total"],
          sql=with_base(*_CTES, final=f"""
SELECT tt.total_revenue, ({D('yt.cb')} / {D('yt.ca')} - {lit(1.0)}) * {lit(100.0)} AS yoy_pct,
       (SELECT avg_retention_pct FROM curve WHERE position = 1) AS month1_retention_pct, tt.customers,
       (SELECT customers FROM ssum WHERE segment = 'Champions') AS champion_customers,
       (SELECT revenue_share FROM ssum WHERE segment = 'Champions') AS champion_share_pct,
       fct.forecast_total FROM tt, yt, fct"""))
def q_project_summary(spark, sf):
    s, seg = _sales_seg(spark, sf)
    return L.project_summary(s, seg, ROLES.year_a, ROLES.year_b)
