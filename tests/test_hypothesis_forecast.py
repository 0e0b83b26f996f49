import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orderscope.functions.distributions import ln_gamma, t_pvalue, z_pvalue
from orderscope.operators import forecast as K
from orderscope.operators import hypothesis as J

from .conftest import sales_frame


def _tails(spark, rows):
    df = spark.createDataFrame([(float(t), float(d)) for t, d in rows], "t double, d double")
    return [r.p for r in df.select(t_pvalue(F.col("t"), F.col("d")).alias("p")).collect()]


def test_t_tail_fixture(spark):
    # FIXTURES "welch_tail"
    p = _tails(spark, [(2.1, 12.5), (0.3, 7.1), (1.96, 1e7), (0.0, 10.0), (math.inf, 3.0), (-2.1, 12.5), (1.0, 1.0), (2.0, 2.0)])
    assert abs(p[0] - 0.0566433072) < 1e-9 and abs(p[1] - 0.7727703539) < 1e-9
    assert abs(p[2] - math.erfc(1.96 / math.sqrt(2))) < 1e-6  # large df tends to the normal tail
    assert abs(p[3] - 1.0) < 1e-12 and p[4] == 0.0 and p[5] == p[0]
    assert abs(p[6] - 0.5) < 1e-12  # Cauchy: 1 - 2 atan(t) / pi
    assert abs(p[7] - (1 - 2 / math.sqrt(6))) < 1e-12  # two degrees of freedom: 1 - t / sqrt(2 + t^2)


def test_t_tail_against_numerical_integration(spark):
    rows = [(t, d) for t in (0.05, 0.7, 1.5, 3.0, 6.0) for d in (2.5, 9.0, 41.3, 1498.0, 24275.0)]
    for (t, d), p in zip(rows, _tails(spark, rows), strict=True):
        x = np.linspace(0, t, 200_001)
        logs = math.lgamma((d + 1) / 2) - math.lgamma(d / 2) - 0.5 * math.log(d * math.pi)
        y = np.exp(logs - (d + 1) / 2 * np.log1p(x * x / d))
        assert abs(p - (1 - 2 * np.trapezoid(y, x))) < 1e-9, (t, d)


def test_undefined_tails_are_null(spark):
    df = spark.createDataFrame([(None, 3.0), (1.0, None), (1.0, 0.0), (math.nan, 2.0)], "t double, d double")
    assert [r.p for r in df.select(t_pvalue(F.col("t"), F.col("d")).alias("p")).collect()] == [None] * 4
    assert df.where("t is null").select(z_pvalue(F.col("t")).alias("p")).first().p is None


def test_normal_tail_and_ln_gamma(spark):
    z = [0.0, 0.1, -1.0, 1.96, 2.8, 2.9, 5.0, -8.0, 20.0, 80.0]
    df = spark.createDataFrame([(x,) for x in z], "z double")
    for x, r in zip(z, df.select(z_pvalue(F.col("z")).alias("p")).collect(), strict=True):
        assert math.isclose(r.p, math.erfc(abs(x) / math.sqrt(2)), rel_tol=1e-10, abs_tol=1e-300)
    g = [0.5, 1.0, 1.5, 7.25, 300.0, 12137.4]
    df = spark.createDataFrame([(x,) for x in g], "z double")
    for x, r in zip(g, df.select(ln_gamma(F.col("z")).alias("g")).collect(), strict=True):
        assert math.isclose(r.g, math.lgamma(x), rel_tol=1e-12, abs_tol=1e-12)


def test_mann_whitney_matches_brute_force_ranks(spark):
    rng = np.random.default_rng(2)
    a = np.round(rng.exponential(50, 60), 0)
    b = np.round(rng.exponential(60, 45), 0)
    rows = [(1, i, float(v)) for i, v in enumerate(a)] + [(2, 1000 + i, float(v)) for i, v in enumerate(b)]
    df = spark.createDataFrame(rows, "sample int, customer_id long, monetary double")
    r = J.mann_whitney_stats(df).collect()[0]
    allv = pd.Series(np.concatenate([a, b]))
    ranks = allv.rank(method="average")
    u1 = ranks[: len(a)].sum() - len(a) * (len(a) + 1) / 2
    assert r.u1 == u1 and r.u1 + r.u2 == len(a) * len(b)
    n = len(allv)
    t = allv.value_counts()
    sig = np.sqrt(len(a) * len(b) / 12 * ((n + 1) - ((t ** 3 - t).sum()) / (n * (n - 1))))
    assert abs(r.sigma - sig) < 1e-9
    assert r.median1 == float(np.median(a)) and r.median2 == float(np.median(b))


def test_channel_samples_overlap(spark):
    # FIXTURES "overlap_channels": a customer with Email and Social orders is in both samples
    s = sales_frame(spark, [(1, 9, "2024-01-01", "c", "p", 1, 10.0, "r", "E"),
                            (2, 9, "2024-01-02", "c", "p", 1, 10.0, "r", "S"),
                            (3, 8, "2024-01-03", "c", "p", 1, 10.0, "r", "E")])
    rfm = s.groupBy("customer_id").agg(F.sum("revenue").alias("monetary"))
    got = sorted((r.sample, r.customer_id) for r in J.channel_samples(s, rfm, "E", "S").collect())
    assert got == [(1, 8), (1, 9), (2, 9)]


def test_welch_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(100, 10000, 80)
    flag = rng.random(80) < 0.4
    df = spark.createDataFrame([(bool(f), int(c)) for f, c in zip(flag, x)], "f boolean, cents long")
    r = J.welch_stats(df, "cents", "f").collect()[0]
    a, b = x[flag] / 100, x[~flag] / 100
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    assert abs(r.t - (a.mean() - b.mean()) / np.sqrt(va + vb)) < 1e-9
    assert abs(r.df - (va + vb) ** 2 / (va ** 2 / (len(a) - 1) + vb ** 2 / (len(b) - 1))) < 1e-6


def _series(spark, values, start="2021-01-01"):
    d0 = dt.date.fromisoformat(start)
    rows = []
    for i, v in enumerate(values):
        y, m = d0.year + (d0.month - 1 + i) // 12, (d0.month - 1 + i) % 12 + 1
        rows.append((dt.date(y, m, 1), m, i, int(round(float(v) * 100)), round(float(v), 2)))
    return spark.createDataFrame(rows, "year_month date, month int, t int, cents long, revenue double")


def _lstsq_fit(values, months, t):
    X = np.column_stack([t] + [(months == m).astype(float) for m in range(1, 13)])
    Xc, yc = X - X.mean(0), values - values.mean()
    coef = np.linalg.lstsq(Xc, yc, rcond=None)[0]
    return coef, values.mean() - X.mean(0) @ coef


def test_forecast_matches_min_norm_least_squares(spark):
    rng = np.random.default_rng(8)
    vals = np.round(1000 + 10 * np.arange(30) + rng.normal(0, 30, 30), 2)
    ser = _series(spark, vals)
    months = np.array([(i % 12) + 1 for i in range(30)])
    coef, icpt = _lstsq_fit(vals, months, np.arange(30.0))
    fv = K.fitted_values(ser).orderBy("t").toPandas()
    X = np.column_stack([np.arange(30.0)] + [(months == m).astype(float) for m in range(1, 13)])
    assert np.allclose(fv["fitted"].to_numpy(), X @ coef + icpt, atol=1e-6)
    fc = K.forecast_band(ser, 6).orderBy("t").toPandas()
    tf = np.arange(30, 36.0)
    mf = np.array([(i % 12) + 1 for i in range(30, 36)])
    Xf = np.column_stack([tf] + [(mf == m).astype(float) for m in range(1, 13)])
    assert np.allclose(fc["forecast"].to_numpy(), Xf @ coef + icpt, atol=1e-6)
    resid = vals - (X @ coef + icpt)
    assert np.allclose(fc["upper"] - fc["forecast"], 1.96 * np.std(resid), atol=1e-6)


def test_forecast_unseen_month_and_one_year(spark):
    # FIXTURES "unseen_month": 40 months that never contain May; "one_year": 12 months -> NULL slope
    rng = np.random.default_rng(1)
    dates, vals = [], []
    y, m = 2020, 7  # ends in January: the horizon reaches the unseen May
    while len(dates) < 40:
        if m != 5:
            dates.append((y, m))
            vals.append(round(float(500 + 3 * len(dates) + rng.normal(0, 5)), 2))
        m += 1
        if m == 13:
            y, m = y + 1, 1
    rows = [(dt.date(a, b, 1), b, i, int(round(v * 100)), float(v)) for i, ((a, b), v) in enumerate(zip(dates, vals))]
    ser = spark.createDataFrame(rows, "year_month date, month int, t int, cents long, revenue double")
    months = np.array([b for _, b in dates])
    coef, icpt = _lstsq_fit(np.array(vals), months, np.arange(40.0))
    fc = K.forecast_band(ser, 6).orderBy("t").toPandas()
    tf = np.arange(40, 46.0)
    mf = fc["year_month"].map(lambda d: d.month).to_numpy()
    assert 5 in mf
    Xf = np.column_stack([tf] + [(mf == k).astype(float) for k in range(1, 13)])
    assert np.allclose(fc["forecast"].to_numpy(), Xf @ coef + icpt, atol=1e-6)
    one = K.trend_seasonal_fit(_series(spark, list(range(12)))).collect()
    assert all(r.slope is None for r in one)
