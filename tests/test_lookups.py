import numpy as np
import pandas as pd
import pytest

from orderscope.operators.distributions import box_stats
from orderscope.plans import lookups


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _box_reference(x, whis=1.5):
    """matplotlib's boxplot statistics with NumPy (whiskers, flier count)."""
    x = np.asarray(x, dtype=float)
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    iqr = q3 - q1
    loval, hival = q1 - whis * iqr, q3 + whis * iqr
    hi = x[x <= hival]
    whi = q3 if len(hi) == 0 or hi.max() < q3 else hi.max()
    lo = x[x >= loval]
    wlo = q1 if len(lo) == 0 or lo.min() > q1 else lo.min()
    return len(x), q1, med, q3, wlo, whi, int(((x < wlo) | (x > whi)).sum())


def test_box_stats_matches_numpy_whiskers(spark):
    rng = np.random.default_rng(5)
    groups = {
        "spread": np.round(rng.lognormal(3, 1, 300), 2),          # fliers above
        "both": np.concatenate([rng.normal(50, 1, 100).round(1), [0.0, 1.0, 200.0]]),
        "tied": np.array([4.0] * 30 + [9.0, -3.0]),               # iqr = 0
        "two": np.array([1.0, 10.0]),                              # interpolated q3, no data in [q3, hival]
        "one": np.array([7.0]),
    }
    pdf = pd.concat([pd.DataFrame({"g": k, "x": v}) for k, v in groups.items()], ignore_index=True)
    got = box_stats(spark.createDataFrame(pdf), "x", ["g"]).toPandas().set_index("g")
    for k, v in groups.items():
        n, q1, med, q3, wlo, whi, out = _box_reference(v)
        row = got.loc[k]
        assert (row["count"], row["outliers"]) == (n, out), k
        assert np.allclose([row[c] for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                           [q1, med, q3, wlo, whi], rtol=0, atol=1e-12), k


@pytest.mark.parametrize("limit", [0, 1000])
def test_lookup_join_both_branches(spark, limit):
    rows = spark.range(0, 2000).selectExpr("id", "id % 3 AS k")
    table = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, name string")
    out = lookups.lookup_join(rows, table, ["k"], max_rows=limit)
    got = sorted(map(tuple, out.select("id", "name").collect()))
    assert got == [(i, "abc"[i % 3]) for i in range(2000)]
    p = _plan(out)
    if limit:  # small and checked: rows stay where they are
        assert "BroadcastHashJoin" in p and "Exchange hashpartitioning(k" not in p
