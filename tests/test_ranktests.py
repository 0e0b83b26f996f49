"""Exact Mann-Whitney p-values against enumeration of all rank choices."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from orderscope.operators import hypothesis as J
from orderscope.operators import ranktests as R

KIND = "g string, n1 long, n2 long, u1 double, u2 double, tie_term double"


def enumerated(n1, n2, u):
    """P(U <= u) over all choices of n1 ranks."""
    all_u = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    return sum(x <= u for x in all_u) / len(all_u)


def test_equal_to_enumeration_for_all_small_sizes(spark):
    rows = [(f"{a}-{b}-{u}", a, b, float(u), float(a * b - u), 0.0)
            for a in range(1, 9) for b in range(1, 9) for u in range(0, a * b // 2 + 1, 1 if a * b < 30 else 5)]
    got = {r.g: r.p_exact for r in R.with_exact_p(spark.createDataFrame(rows, KIND), ["g"]).collect()}
    for g, a, b, u, _, _ in rows:
        assert math.isclose(got[g], min(1.0, 2 * enumerated(a, b, u)), rel_tol=1e-11), g


def counted(m, n, u):
    """Numbers of choices with U <= u and in all, by the counting recurrence over ranks."""
    ways = [[0] * (u + 1) for _ in range(m + 1)]
    ways[0][0] = 1
    for below in range(n + 1):  # the chosen values with ``below`` smaller others
        for k in range(1, m + 1):
            for s in range(below, u + 1):
                ways[k][s] += ways[k - 1][s - below]
    return sum(ways[m]), math.comb(n + m, m)


def test_large_other_sample(spark):
    rows = [(f"{m}-{n}-{u}", n, m, float(m * n - u), float(u), 0.0)
            for m, n, u in [(8, 60, 240), (8, 60, 61), (8, 60, 0), (5, 101, 7), (3, 300, 450), (1, 1000, 499)]]
    got = {r.g: r.p_exact for r in R.with_exact_p(spark.createDataFrame(rows, KIND), ["g"]).collect()}
    for g, n, m, _, u, _ in rows:
        low, all_ = counted(m, n, int(u))
        assert math.isclose(got[g], min(1.0, 2 * low / all_), rel_tol=1e-9), g
    # one value against very many: uniform over n + 1 places
    one = spark.createDataFrame([("a", 1, 10_000_000, 99_999.0, 9_900_001.0, 0.0)], KIND)
    assert math.isclose(R.with_exact_p(one, ["g"]).first().p_exact, 2 * 100_000 / 10_000_001, rel_tol=1e-12)


def test_undefined_cases_are_null(spark):
    rows = [("ties", 3, 3, 2.0, 7.0, 6.0), ("large", 9, 9, 40.0, 41.0, 0.0), ("empty", 0, 4, 0.0, 0.0, 0.0)]
    got = R.with_exact_p(spark.createDataFrame(rows, KIND), ["g"])
    assert {r.g: r.p_exact for r in got.collect()} == {"ties": None, "large": None, "empty": None}
    assert R.with_exact_p(got.drop("p_exact").limit(0), ["g"]).count() == 0


def test_groups_by_their_values(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g, (n1, n2) in {"a": (3, 9), "b": (2, 4), "c": (0, 5), None: (5, 6)}.items():
        v = rng.permutation(100)[:n1 + n2].tolist()
        rows += [(g, 1 if i < n1 else 2, x) for i, x in enumerate(v)] + [(g, 1, None)]
        u1 = sum(x > y for x in v[:n1] for y in v[n1:])
        want[g] = (n1, n2, float(u1), min(1.0, 2 * enumerated(n1, n2, min(u1, n1 * n2 - u1))) if n1 else None)
    df = spark.createDataFrame(rows, "g string, sample int, v long")
    for r in R.rank_tests(df, "v", ["g"]).collect():
        n1, n2, u1, p = want.pop(r.g)
        assert (r.n1, r.n2, r.u1) == (n1, n2, u1) and (r.p_exact is None) == (p is None)
        assert p is None or math.isclose(r.p_exact, p, rel_tol=1e-12)
    assert not want


def test_report_is_exact_for_small_samples(spark):
    rows = [(1, i, float(v)) for i, v in enumerate([5, 9, 11])] + [(2, 10 + i, float(v)) for i, v in enumerate([1, 2, 3, 4, 7])]
    mw = J.mann_whitney_stats(spark.createDataFrame(rows, "sample int, customer_id long, monetary double"))
    welch = spark.createDataFrame([(None, None)], "t double, df double")
    line = spark.createDataFrame([(0.5, 1.0, 8.0)], "r double, t double, df double")
    got = J.hypothesis_report(welch, mw, line, welch).where(F.col("test") == "email_vs_social_ltv").first()
    assert math.isclose(got.p_value, 2 * enumerated(3, 5, 1), rel_tol=1e-12)
