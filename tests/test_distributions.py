import numpy as np
import pandas as pd

from orderscope.operators.distributions import box_stats, histogram


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(12)
    x = np.round(rng.lognormal(3, 1, 2000), 2)
    x = np.concatenate([x, [x.min(), x.max(), x.max()]])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    h = histogram(df, "x", 60).orderBy("bin").toPandas()
    cnt, edges = np.histogram(x, bins=60)
    assert list(h["count"]) == list(cnt)
    assert np.array_equal(h["bin_lo"].to_numpy(), edges[:-1]) and np.array_equal(h["bin_hi"].to_numpy(), edges[1:])
    dens, _ = np.histogram(x, bins=50, density=True)
    h50 = histogram(df, "x", 50).orderBy("bin").toPandas()
    assert np.allclose(h50["density"].to_numpy(), dens, rtol=1e-12)


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "x double")
    h = histogram(df, "x", 10).orderBy("bin").toPandas()
    cnt, edges = np.histogram(np.array([5.0] * 4), bins=10)
    assert list(h["count"]) == list(cnt) and np.array_equal(h["bin_lo"].to_numpy(), edges[:-1])


def test_box_stats_match_matplotlib_rules(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in ("a", "b"):
        v = np.round(rng.lognormal(2, 0.8, 300), 2)
        rows += [(g, float(x)) for x in v]
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    out = box_stats(spark.createDataFrame(pdf), "x", ["g"]).toPandas().set_index("g")
    for g, sub in pdf.groupby("g"):
        x = sub["x"].to_numpy()
        q1, med, q3 = np.percentile(x, [25, 50, 75])
        iqr = q3 - q1
        hi = x[x <= q3 + 1.5 * iqr].max()
        lo = x[x >= q1 - 1.5 * iqr].min()
        r = out.loc[g]
        assert (r.q1, r["median"], r.q3, r.whisker_lo, r.whisker_hi) == (q1, med, q3, lo, hi)
        assert r.outliers == int(((x < lo) | (x > hi)).sum())
