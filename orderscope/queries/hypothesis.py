"""Test statistics and the p-value report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hypothesis as J
from ..operators import trends as T
from ..operators.ranktests import rank_tests
from ..operators.rfm import rfm_base
from ..oracles import D, H, exact_double, lit, q_quantiles, with_base
from ..registry import register
from ..sources.sales import ROLES, load_sales
from ._common import MONTH
from .rfm import RFM_CTE


def welch_sql(rel: str, flag: str, cents: str) -> str:
    def side(cond, k):
        return (f"count(*) FILTER (WHERE {cond}) AS n{k}, sum({cents}) FILTER (WHERE {cond}) AS s{k}, "
                f"sum({H(cents)} * {H(cents)}) FILTER (WHERE {cond}) AS ss{k}")
    base = f"SELECT {side(flag, '1')}, {side('NOT ' + flag, '2')} FROM {rel}"
    mv = ", ".join(
        f"{D(f's{k}')} / {D(f'n{k}')} / {lit(100.0)} AS mean{k}, "
        f"{exact_double(f'{H(f'n{k}')} * ss{k} - {H(f's{k}')} * {H(f's{k}')}')} "
        f"/ ({D(f'n{k}')} * {D(f'n{k} - 1')}) / {lit(10000.0)} AS var{k}" for k in ("1", "2"))
    s1, s2 = f"(var1 / {D('n1')})", f"(var2 / {D('n2')})"
    return (f"SELECT n1, n2, mean1, mean2, var1, var2, (mean1 - mean2) / sqrt({s1} + {s2}) AS t, "
            f"({s1} + {s2}) * ({s1} + {s2}) / ({s1} * {s1} / {D('n1 - 1')} + {s2} * {s2} / {D('n2 - 1')}) AS df "
            f"FROM (SELECT *, {mv} FROM ({base}) _b) _w")


_WELCH = ["mean1", "mean2", "var1", "var2", "t", "df"]


@register("welch_weekend_aov", group="hypothesis", doubles=_WELCH, sql=with_base(
    ("wk", "SELECT isodow(order_date) >= 6 AS is_weekend, revenue, cents FROM sales"),
    final=welch_sql("wk", "is_weekend", "cents")))
def q_welch_weekend_aov(spark, sf):
    return J.welch_stats(J.weekend_flag(load_sales(spark, sf)), "cents", "is_weekend")


SAMPLE_CTES = [
    RFM_CTE,
    ("em", f"SELECT DISTINCT customer_id FROM sales WHERE channel = '{ROLES.email_channel}'"),
    ("so", f"SELECT DISTINCT customer_id FROM sales WHERE channel = '{ROLES.social_channel}'"),
    ("smp", "SELECT 1 AS sample, customer_id, monetary FROM rfm WHERE customer_id IN (SELECT customer_id FROM em) "
            "UNION ALL SELECT 2 AS sample, customer_id, monetary FROM rfm "
            "WHERE customer_id IN (SELECT customer_id FROM so)"),
]


def _samples(spark, sf):
    s = load_sales(spark, sf)
    return J.channel_samples(s, rfm_base(s), ROLES.email_channel, ROLES.social_channel)


@register("channel_ltv", group="hypothesis", doubles=["monetary"],
          sql=with_base(*SAMPLE_CTES, final="SELECT * FROM smp"))
def q_channel_ltv(spark, sf):
    return _samples(spark, sf)


_N1N2 = f"({D('n1')} * {D('n2')})"
_MW_CTES = SAMPLE_CTES + [
    ("vc", "SELECT monetary, count(*) FILTER (WHERE sample = 1) AS c1, count(*) FILTER (WHERE sample = 2) AS c2, "
           "count(*) AS c FROM smp GROUP BY monetary"),
    ("rk", "SELECT *, coalesce(sum(c) OVER (ORDER BY monetary ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
           "AS below FROM vc"),
    ("ag", "SELECT sum(c1) AS n1, sum(c2) AS n2, sum(CAST(c1 AS HUGEINT) * (2 * below + c + 1)) AS two_r1, "
           "sum(CAST(c AS HUGEINT) * c * c - c) AS tie FROM rk"),
    ("u", f"SELECT n1, n2, {D('two_r1')} / {lit(2.0)} - {D('n1')} * ({D('n1')} + {lit(1.0)}) / {lit(2.0)} AS u1, "
          f"{D('tie')} AS tie_term, "
          f"sqrt({_N1N2} / {lit(12.0)} * (({D('n1 + n2')} + {lit(1.0)}) - {D('tie')} / "
          f"({D('n1 + n2')} * ({D('n1 + n2')} - {lit(1.0)})))) AS sigma FROM ag"),
    ("md", q_quantiles("smp", "monetary", [0.5], ["sample"], ["median"], median=True)),
]


@register("mannwhitney_channel_ltv", group="hypothesis",
          doubles=["u1", "tie_term", "sigma", "u2", "z", "median1", "median2"],
          sql=with_base(*_MW_CTES, final=f"""
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, u1, tie_term, sigma, {_N1N2} - u1 AS u2,
       (greatest(u1, {_N1N2} - u1) - {_N1N2} / {lit(2.0)} - {lit(0.5)}) / sigma AS z,
       (SELECT median FROM md WHERE sample = 1) AS median1, (SELECT median FROM md WHERE sample = 2) AS median2
FROM u"""))
def q_mannwhitney_channel_ltv(spark, sf):
    return J.mann_whitney_stats(_samples(spark, sf))


@register("pearson_freq_ltv", group="hypothesis", doubles=["r", "t", "df"], sql=with_base(RFM_CTE, final=f"""
SELECT r, n, CASE WHEN abs(r) >= 1.0 THEN NULL ELSE r * sqrt({D('n - 2')} / ({lit(1.0)} - r * r)) END AS t,
       {D('n - 2')} AS df, CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength,
       CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'none' END AS sign
FROM (SELECT corr(frequency, monetary) AS r, count(*) AS n FROM rfm)"""))
def q_pearson_freq_ltv(spark, sf):
    return J.pearson_stats(rfm_base(load_sales(spark, sf)), "frequency", "monetary")


_Q4 = ("q4", f"SELECT {MONTH} AS year_month, sum(cents) AS cents, {D('sum(cents)')} / {lit(100.0)} AS revenue, "
             f"quarter({MONTH}) = 4 AS is_q4 FROM sales GROUP BY {MONTH}")


def _q4(spark, sf):
    return J.q4_monthly_split(T.monthly_cents(load_sales(spark, sf)))


@register("q4_monthly_split", group="hypothesis", doubles=["revenue"],
          sql=with_base(_Q4, final="SELECT year_month, CAST(cents AS BIGINT) AS cents, revenue, is_q4 FROM q4"))
def q_q4_monthly_split(spark, sf):
    return _q4(spark, sf)


@register("welch_q4", group="hypothesis", doubles=_WELCH,
          sql=with_base(_Q4, final=welch_sql("q4", "is_q4", "cents")))
def q_welch_q4(spark, sf):
    return J.welch_stats(_q4(spark, sf), "cents", "is_q4")


# every subset of the ranks 1..12, by size, largest rank and total
_Q4_RANKS = with_base(
    _Q4,
    ("rk", f"SELECT year(year_month) AS y, is_q4, {D('rank() OVER w')} + ({D('count(*) OVER t')} - {lit(1.0)}) / {lit(2.0)} AS r, "
           "count(*) OVER t AS c FROM q4 WINDOW w AS (PARTITION BY year(year_month) ORDER BY cents), "
           "t AS (PARTITION BY year(year_month), cents)"),
    ("yr", f"SELECT y, count(*) FILTER (is_q4) AS n1, count(*) FILTER (NOT is_q4) AS n2, "
           f"coalesce(sum(r) FILTER (is_q4), 0) - {D('n1')} * ({D('n1')} + {lit(1.0)}) / {lit(2.0)} AS u1, "
           f"{D('sum(c * c - 1)')} AS tie_term FROM rk GROUP BY y"),
    ("sub", """SELECT 0 AS k, 0 AS last, 0 AS total
  UNION ALL
  SELECT k + 1, CAST(r AS INTEGER), total + CAST(r AS INTEGER) FROM sub, (SELECT unnest(range(1, 13)) AS r) WHERE r > last"""),
    ("tl", f"SELECT y, least({lit(1.0)}, {lit(2.0)} * {D('count(*) FILTER (total - k * (k + 1) / 2 <= least(u1, n1 * n2 - u1))')} "
           f"/ {D('count(*)')}) AS p FROM yr JOIN sub ON k = n1 AND last <= n1 + n2 WHERE n1 > 0 AND n2 > 0 AND tie_term = 0 GROUP BY y"),
    final=f"SELECT CAST(yr.y AS INTEGER) AS year, n1, n2, u1, {D('n1')} * {D('n2')} - u1 AS u2, tie_term, p AS p_exact "
          "FROM yr LEFT JOIN tl ON yr.y = tl.y").replace("WITH ", "WITH RECURSIVE ", 1)


@register("mannwhitney_q4_by_year", group="hypothesis", doubles=["u1", "u2", "tie_term", "p_exact"], sql=_Q4_RANKS)
def q_mannwhitney_q4_by_year(spark, sf):
    """J3 on small samples: monthly revenue of quarter 4 against the year's other months."""
    months = _q4(spark, sf).select(F.year("year_month").alias("year"), F.when(F.col("is_q4"), 1).otherwise(2).alias("sample"), "cents")
    return rank_tests(months, "cents", ["year"])


_PEARSON = f"""SELECT r, n, CASE WHEN abs(r) >= 1.0 THEN NULL ELSE r * sqrt({D('n - 2')} / (1.0::DOUBLE - r * r)) END AS t,
  {D('n - 2')} AS df FROM (SELECT corr(frequency, monetary) AS r, count(*) AS n FROM rfm)"""
_Z = f"(greatest(u1, {_N1N2} - u1) - {_N1N2} / {lit(2.0)} - {lit(0.5)}) / sigma"
# Tails as recursions: continued fraction of the incomplete beta (two-sided t), series of erf (normal)
_TAIL_CTES = [
    ("tw", welch_sql("wk", "is_weekend", "cents")), ("tq", welch_sql("q4", "is_q4", "cents")), ("pe", _PEARSON),
    ("tt", "SELECT 'weekend_vs_weekday_aov' AS test, t AS statistic, df, t FROM tw "
           "UNION ALL SELECT 'frequency_vs_ltv_pearson', r, df, t FROM pe UNION ALL SELECT 'q4_vs_other_months', t, df, t FROM tq"),
    ("bx0", "SELECT test, df / 2 AS a, 0.5::DOUBLE AS b, df / (df + t * t) AS x FROM tt WHERE t IS NOT NULL AND df > 0"),
    ("bx", "SELECT test, flip, CASE WHEN flip THEN b ELSE a END AS a, CASE WHEN flip THEN a ELSE b END AS b, "
           "CASE WHEN flip THEN 1 - x ELSE x END AS x FROM (SELECT *, x >= (a + 1) / (a + b + 2) AS flip FROM bx0)"),
    ("cf", """SELECT test, a, b, x, 1 AS j, 1.0::DOUBLE AS c, 0.0::DOUBLE AS d, 1.0::DOUBLE AS f, false AS done FROM bx
  UNION ALL
  SELECT test, a, b, x, j + 1, c2, d2, f * c2 * d2, abs(c2 * d2 - 1) < 1e-16 FROM (
    SELECT *, 1 + num / c AS c2, 1 / (1 + num * d) AS d2 FROM (
      SELECT *, CASE WHEN j % 2 = 0 THEN (j // 2) * (b - j // 2) * x ELSE -(a + j // 2) * (a + b + j // 2) * x END
                / ((a + j - 1) * (a + j)) AS num
      FROM cf WHERE NOT done AND j <= 5000))"""),
    ("pt", "SELECT test, CASE WHEN flip THEN 1 - low ELSE low END AS p FROM (SELECT bx.test, flip, "
           "exp(lgamma(bx.a + bx.b) - lgamma(bx.a) - lgamma(bx.b) + bx.a * ln(bx.x) + bx.b * ln(1 - bx.x)) / bx.a / l.f AS low "
           "FROM bx JOIN (SELECT test, arg_max(f, j) AS f FROM cf GROUP BY test) l ON bx.test = l.test)"),
    ("zz", f"SELECT u1, abs({_Z}) / sqrt(2.0::DOUBLE) AS x FROM u"),
    ("er", """SELECT 0 AS n, x, x AS term, x AS total FROM zz
  UNION ALL
  SELECT n + 1, x, term * 2 * x * x / (2 * n + 3), total + term * 2 * x * x / (2 * n + 3) FROM er WHERE n < 400"""),
    ("pz", "SELECT 1 - 2 / sqrt(pi()) * exp(-max(x) * max(x)) * arg_max(total, n) AS p FROM er"),
]
_REPORT = with_base(*_MW_CTES, ("wk", "SELECT isodow(order_date) >= 6 AS is_weekend, revenue, cents FROM sales"), _Q4, *_TAIL_CTES, final="""
SELECT *, p_value < 0.05 AS significant FROM (
  SELECT tt.test, statistic, df, least(1.0::DOUBLE, p) AS p_value FROM tt LEFT JOIN pt ON tt.test = pt.test
  UNION ALL SELECT 'email_vs_social_ltv', u1, NULL, (SELECT p FROM pz) FROM u)""").replace("WITH ", "WITH RECURSIVE ", 1)


@register("hypothesis_report", group="hypothesis", doubles=["statistic", "df", "p_value"], sql=_REPORT)
def q_hypothesis_report(spark, sf):
    """Every test with its p-value and verdict."""
    s = load_sales(spark, sf)
    rfm = rfm_base(s)
    w = J.welch_stats(J.weekend_flag(s), "cents", "is_weekend")
    mw = J.mann_whitney_stats(J.channel_samples(s, rfm, ROLES.email_channel, ROLES.social_channel))
    pe = J.pearson_stats(rfm, "frequency", "monetary")
    q4 = J.welch_stats(J.q4_monthly_split(T.monthly_cents(s)), "cents", "is_q4")
    return J.hypothesis_report(w, mw, pe, q4)


_SAMPLE = ("samp", "SELECT customer_id, frequency, monetary FROM rfm ORDER BY "
                   "CAST(CAST(customer_id AS HUGEINT) * 2654435761 % 4294967296 AS BIGINT), customer_id LIMIT 1000")


@register("sample_customers", group="hypothesis", doubles=["monetary"],
          sql=with_base(RFM_CTE, _SAMPLE, final="SELECT * FROM samp"))
def q_sample_customers(spark, sf):
    return J.sample_customers(rfm_base(load_sales(spark, sf)))


@register("freq_ltv_line", group="hypothesis", doubles=["x", "slope", "intercept", "y"], sql=with_base(
    RFM_CTE, _SAMPLE,
    ("sc", "SELECT frequency, CAST(round_even(monetary * 100.0::DOUBLE, 0) AS BIGINT) AS cents FROM samp"),
    ("sm", f"SELECT count(*) AS n, sum(frequency) AS sx, sum(cents) AS sy, sum({H('frequency')} * cents) AS sxy, "
           f"sum({H('frequency')} * frequency) AS sxx, {D('min(frequency)')} AS lo, {D('max(frequency)')} AS hi FROM sc"),
    ("fl", f"SELECT {exact_double(f'{H('n')} * sxy - {H('sx')} * {H('sy')}')} "
           f"/ {exact_double(f'{H('n')} * sxx - {H('sx')} * {H('sx')}')} / {lit(100.0)} AS slope, "
           f"{exact_double(f'{H('sy')} * sxx - {H('sx')} * sxy')} "
           f"/ {exact_double(f'{H('n')} * sxx - {H('sx')} * {H('sx')}')} / {lit(100.0)} AS intercept, lo, hi FROM sm"),
    ("pts", f"SELECT CAST(i AS INTEGER) AS i, CASE WHEN i = 99 THEN hi ELSE {D('i')} * ((hi - lo) / {lit(99.0)}) + lo END "
            f"AS x, slope, intercept FROM fl, (SELECT unnest(range(0, 100)) AS i) r"),
    final="SELECT i, x, slope, intercept, slope * x + intercept AS y FROM pts"))
def q_freq_ltv_line(spark, sf):
    return J.fit_line(J.with_cents(J.sample_customers(rfm_base(load_sales(spark, sf)))))
