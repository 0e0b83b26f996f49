"""Bounds of the Euclidean silhouette against all pairs."""

import numpy as np
import pytest

from orderscope.operators import segments as G
from orderscope.operators import silhouette as S

KIND = "cluster int, " + ", ".join(f"{z} double" for z in G.Z)


def frame(spark, lab, x):
    return spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(lab, x, strict=True)], KIND)


def pairwise(lab, x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = lab == lab[i]
        a, b = d[i][own].sum() / max(own.sum() - 1, 1), min(d[i][lab == c].mean() for c in set(lab) - {lab[i]})
        out.append(0.0 if own.sum() == 1 or a == b else (b - a) / max(a, b))
    return float(np.mean(out))


@pytest.mark.parametrize("spread", [0.2, 1.0, 30.0])
def test_bounds_hold_the_pairwise_value(spark, monkeypatch, spread):
    monkeypatch.setattr(S, "PAIRS", 500)  # many steps
    rng = np.random.default_rng(4)
    lab = np.array([i % 3 for i in range(240)] + [7])  # one customer alone
    x = rng.normal(size=(241, 3)) * spread + lab[:, None]
    r = S.silhouette_bounds(frame(spark, lab, x).repartition(5)).first()
    assert (r.customers, r.clusters) == (241, 4)
    assert r.silhouette_low - 1e-9 <= pairwise(lab, x) <= r.silhouette_high + 1e-9
    if spread == 1.0:
        assert r.silhouette_high - r.silhouette_low < 0.1


def test_equal_customers_make_it_exact(spark):
    x = np.array([[0, 0, 0]] * 3 + [[3, 4, 0]] * 2 + [[0, 0, 9]], float)
    lab = np.array([0, 0, 0, 1, 1, 2])
    r = S.silhouette_bounds(frame(spark, lab, x)).first()
    assert np.isclose(r.silhouette_low, pairwise(lab, x)) and np.isclose(r.silhouette_high, pairwise(lab, x))


def test_fewer_than_two_clusters(spark):
    df = frame(spark, [1, 1], np.zeros((2, 3)))
    assert tuple(S.silhouette_bounds(df).first()) == (2, 1, None, None)
    assert tuple(S.silhouette_bounds(df.limit(0)).first()) == (0, 0, None, None)
