"""K1–K9: monthly series, closed-form trend + season fit, forecast."""

from __future__ import annotations

from ..operators import forecast as K
from ..oracles import D, lit, money, with_base
from ..registry import register
from ..sources.sales import load_sales
from ._common import MONTH

H, Z = 6, 1.96


def fc_ctes(keys: list[str], horizon: int = H, z: float = Z) -> list[tuple[str, str]]:
    k = "".join(f"{x}, " for x in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    on = lambda a, b, extra=(): " AND ".join([f"{a}.{x} = {b}.{x}" for x in list(keys) + list(extra)]) or "TRUE"
    return [
        ("ms", f"SELECT {k}{MONTH} AS year_month, sum(cents) AS cents FROM sales GROUP BY {k}{MONTH}"),
        ("ser", f"SELECT {k}year_month, CAST(month(year_month) AS INTEGER) AS month, "
                f"CAST(row_number() OVER ({part}ORDER BY year_month) - 1 AS INTEGER) AS t, cents, "
                f"{money('cents')} AS revenue FROM ms"),
        ("mm", f"SELECT {k}month, count(*) AS n_m, {D('sum(t)')} / {D('count(*)')} AS mean_t, "
               f"{D('sum(cents)')} / {D('count(*)')} / {lit(100.0)} AS mean_y FROM ser GROUP BY {k}month"),
        ("dd", f"SELECT {''.join(f's.{x}, ' for x in keys)}{D('s.t')} - m.mean_t AS dt, s.revenue - m.mean_y AS dy "
               f"FROM ser s JOIN mm m ON {on('s', 'm', ['month'])}"),
        ("sl", f"SELECT {k}CASE WHEN sum(dt * dt) > 0 THEN sum(dt * dy) / sum(dt * dt) END AS slope FROM dd {grp}"),
        ("fv0", f"SELECT {''.join(f's.{x}, ' for x in keys)}s.year_month, s.t, s.revenue, "
                f"m.mean_y + l.slope * ({D('s.t')} - m.mean_t) AS fitted "
                f"FROM ser s JOIN mm m ON {on('s', 'm', ['month'])} JOIN sl l ON {on('s', 'l')}"),
        ("fv", "SELECT *, revenue - fitted AS residual FROM fv0"),
        ("yb", f"SELECT {k}{D('sum(cents)')} / {D('count(*)')} / {lit(100.0)} AS ybar FROM ser {grp}"),
        ("dg", f"SELECT {''.join(f'f.{x}, ' for x in keys)}count(*) AS n, max(f.t) AS last_t, "
               f"max(f.year_month) AS last_month, "
               f"{lit(1.0)} - sum(f.residual * f.residual) / sum((f.revenue - y.ybar) * (f.revenue - y.ybar)) AS r2, "
               f"sqrt(sum(f.residual * f.residual) / {D('count(*)')}) AS resid_std "
               f"FROM fv f JOIN yb y ON {on('f', 'y')} {grp.replace('GROUP BY ', 'GROUP BY ' + '')}"
               .replace(f"GROUP BY {', '.join(keys)}", "GROUP BY " + ", ".join(f"f.{x}" for x in keys))),
        ("fut", f"SELECT {k}CAST(last_month + to_months(CAST(h AS INTEGER)) AS DATE) AS year_month, "
                f"CAST(last_t + h AS INTEGER) AS t, resid_std "
                f"FROM dg, (SELECT unnest(range(1, {horizon + 1})) AS h) hh"),
        ("ab", f"SELECT {''.join(f'm.{x}, ' for x in keys)}avg(m.mean_y - l.slope * m.mean_t) AS a_bar "
               f"FROM mm m JOIN sl l ON {on('m', 'l')} "
               + (f"GROUP BY {', '.join(f'm.{x}' for x in keys)}" if keys else "")),
        ("fc", f"SELECT {''.join(f'f.{x}, ' for x in keys)}f.year_month, f.t, f.resid_std, "
               f"CASE WHEN m.mean_y IS NOT NULL THEN m.mean_y + l.slope * ({D('f.t')} - m.mean_t) "
               f"ELSE a.a_bar + l.slope * {D('f.t')} END AS forecast "
               f"FROM fut f JOIN sl l ON {on('f', 'l')} "
               f"LEFT JOIN mm m ON {on('f', 'm')} AND m.month = month(f.year_month) "
               f"JOIN ab a ON {on('f', 'a')}"),
        ("band", f"SELECT {k}year_month, t, forecast, forecast - {lit(z)} * resid_std AS lower, "
                 f"forecast + {lit(z)} * resid_std AS upper FROM fc"),
    ]


CT = fc_ctes([])


def _series(spark, sf, by=()):
    return K.monthly_series(load_sales(spark, sf), by)


@register("monthly_series", group="forecast", doubles=["revenue"],
          sql=with_base(*CT, final="SELECT year_month, month, t, revenue FROM ser"))
def q_monthly_series(spark, sf):
    return _series(spark, sf).drop("cents")


@register("month_dummies", group="forecast", sql=with_base(*CT, final="SELECT year_month, t, " + ", ".join(
    f"CAST(month = {m} AS INTEGER) AS month_{m}" for m in range(1, 13)) + " FROM ser"))
def q_month_dummies(spark, sf):
    return K.month_dummies(_series(spark, sf))


@register("trend_seasonal_fit", group="forecast", doubles=["mean_t", "mean_y", "slope", "month_effect"],
          sql=with_base(*CT, final="SELECT m.month, m.n_m AS months, m.mean_t, m.mean_y, l.slope, "
                                   "m.mean_y - l.slope * m.mean_t AS month_effect FROM mm m, sl l"))
def q_trend_seasonal_fit(spark, sf):
    return K.trend_seasonal_fit(_series(spark, sf))


@register("fitted_values", group="forecast", doubles=["revenue", "fitted", "residual"],
          sql=with_base(*CT, final="SELECT year_month, t, revenue, fitted, residual FROM fv"))
def q_fitted_values(spark, sf):
    return K.fitted_values(_series(spark, sf))


@register("forecast_diagnostics", group="forecast", doubles=["r2", "resid_std", "forecast_total"],
          sql=with_base(*CT, final=f"SELECT d.r2, d.resid_std, {H} AS horizon, "
                                   "(SELECT sum(forecast) FROM fc) AS forecast_total, d.n, d.last_month FROM dg d"))
def q_forecast_diagnostics(spark, sf):
    return K.forecast_summary(_series(spark, sf), H, Z)


@register("revenue_forecast", group="forecast", doubles=["forecast", "lower", "upper"],
          sql=with_base(*CT, final="SELECT * FROM band"))
def q_revenue_forecast(spark, sf):
    return K.forecast_band(_series(spark, sf), H, Z)


@register("forecast_by_category", group="forecast", doubles=["forecast", "lower", "upper"],
          sql=with_base(*fc_ctes(["category"]), final="SELECT * FROM band"))
def q_forecast_by_category(spark, sf):
    """K9: the same model fitted for every category at once (group keys in every partition)."""
    return K.forecast_band(_series(spark, sf, ["category"]), H, Z, ["category"])
