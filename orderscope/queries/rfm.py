"""RFM base, scores (both branches) and their description."""

from __future__ import annotations

from ..operators import rfm as R
from ..oracles import D, lit, money, q_quantiles, with_base
from ..registry import register
from ..sources.sales import ROLES, derived, load_sales
from .quality import describe_sql

RFM_CTE = ("rfm", f"""SELECT customer_id,
    CAST(date_diff('day', max(order_date), (SELECT max(order_date) + 1 FROM sales)) AS INTEGER) AS recency,
    count(*) AS frequency, {money('sum(cents)')} AS monetary FROM sales GROUP BY customer_id""")


def edges_cte(name: str, rel: str, value: str):
    return (name, q_quantiles(rel, value, R.QUINTILE_PROBS, [], R.EDGES))


def score_sql(x: str, ed: str, reverse: bool = False) -> str:
    e = [f"{ed}.e{i}" for i in range(6)]
    distinct = " AND ".join(f"{e[i]} < {e[i + 1]}" for i in range(5))
    step = f"(({e[5]} - {e[0]}) / {lit(5.0)})"
    q = " + ".join(["1"] + [f"(CASE WHEN {x} > {e[i]} THEN 1 ELSE 0 END)" for i in range(1, 5)])
    c = " + ".join(["1"] + [f"(CASE WHEN {x} > {lit(float(i))} * {step} + {e[0]} THEN 1 ELSE 0 END)"
                            for i in range(1, 5)])
    s = f"(CASE WHEN {distinct} THEN {q} WHEN {e[0]} = {e[5]} THEN 3 ELSE {c} END)"
    if reverse:
        s = f"(6 - {s})"
    return f"CAST({s} AS INTEGER)"


def method_sql(ed: str) -> str:
    e = [f"{ed}.e{i}" for i in range(6)]
    return f"(CASE WHEN {' AND '.join(f'{e[i]} < {e[i + 1]}' for i in range(5))} THEN 'qcut' ELSE 'cut' END)"


SCORES_CTES = [
    RFM_CTE,
    edges_cte("er", "rfm", "recency"), edges_cte("ef", "rfm", "frequency"), edges_cte("em", "rfm", "monetary"),
    ("sc0", f"""SELECT rfm.*, {score_sql(D('recency'), 'er', True)} AS r, {score_sql(D('frequency'), 'ef')} AS f,
        {score_sql('monetary', 'em')} AS m FROM rfm, er, ef, em"""),
    ("scores", "SELECT *, r * 100 + f * 10 + m AS rfm_score, r + f + m AS rfm_total FROM sc0"),
]


def customers(spark, sf):
    """The per-customer table, made once per snapshot of ``sales`` and shared by the
    scores, segments and fits."""
    return derived(spark, sf, "customers-1", R.rfm_base)


def rfm_scores_df(spark, sf):
    return R.rfm_scores(customers(spark, sf))


@register("rfm_base", group="rfm", doubles=["monetary"], sql=with_base(RFM_CTE, final="SELECT * FROM rfm"))
def q_rfm_base(spark, sf):
    return R.rfm_base(load_sales(spark, sf))


@register("rfm_scores", group="rfm", doubles=["monetary"],
          sql=with_base(*SCORES_CTES, final="SELECT * FROM scores"))
def q_rfm_scores(spark, sf):
    return rfm_scores_df(spark, sf)


@register("quintile_fallback", group="rfm", sql=with_base(
    ("u", f"""SELECT customer_id, count(DISTINCT CASE WHEN channel = '{ROLES.urgent_channel}'
              THEN order_id // 10 END) AS urgent_orders FROM sales GROUP BY 1"""),
    edges_cte("eu", "u", "urgent_orders"),
    final=f"SELECT u.customer_id, u.urgent_orders, {score_sql(D('u.urgent_orders'), 'eu')} AS score, "
          f"{method_sql('eu')} AS method FROM u, eu"))
def q_quintile_fallback(spark, sf):
    u = R.urgent_orders(load_sales(spark, sf), ROLES.urgent_channel)
    return R.quintile_score(u, "urgent_orders", "score", method_col="method")


_rd_ctes, _rd_final = describe_sql("scores", R.RFM_DESCRIBE_COLS, {"monetary": 100})


@register("rfm_describe", group="rfm", doubles=["mean", "std", "min", "p25", "p50", "p75", "max"],
          sql=with_base(*SCORES_CTES, *_rd_ctes, final=_rd_final))
def q_rfm_describe(spark, sf):
    return R.rfm_describe(rfm_scores_df(spark, sf))
