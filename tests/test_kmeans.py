"""K-means against a plain Lloyd run and its own properties."""

import numpy as np
import pytest

from orderscope.operators import kmeans as M
from orderscope.operators import segments as G

KIND = "customer_id long, recency int, frequency long, monetary double"


@pytest.fixture(scope="module")
def rfm(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        c = i % 3
        rows.append((i, int(rng.integers(1, 60) + 150 * c), int(rng.integers(1, 9) + 8 * (2 - c)),
                     float(np.round(rng.lognormal(5 + c, .5), 2))))
    return spark.createDataFrame(rows, KIND)


def plain_lloyd(x, c, tol=1e-4):
    for _ in range(300):
        a = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[a == k].mean(0) if (a == k).any() else c[k] for k in range(len(c))])
        moved, c = ((new - c) ** 2).sum(), new
        if moved <= tol:
            break
    return ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()


def test_fits_do_not_depend_on_partitions(spark, rfm):
    found = []
    for n in (1, 4, 32):
        scaled, scale = M.points(rfm.repartition(n))
        starts = M.start_sequences(scaled, 3, 5)
        found.append((starts, [c for c, _ in M.lloyd(scaled, scale, [s[:3] for s in starts])]))
    assert found[0] == found[1] == found[2]


def test_equals_plain_lloyd_and_inertia_falls(spark, rfm):
    scaled, scale = M.points(rfm)
    x = np.array(scaled.select(*G.Z).collect(), float)
    sequences = M.start_sequences(scaled, 3, 5)
    starts = [s[:k] for k in (2, 3, 4, 5) for s in sequences]
    models = M.lloyd(scaled, scale, starts)
    for (_, cost), start in zip(models, starts, strict=True):
        assert np.isclose(cost, plain_lloyd(x, np.array(start)), rtol=1e-9)
    best = M.best_models(scaled, scale, [2, 3, 4, 5], 3)
    for j, k in enumerate(best):
        assert best[k][1] <= min(c for _, c in models[3 * j:3 * j + 3])
    assert all(a > b for (_, a), (_, b) in zip(list(best.values()), list(best.values())[1:], strict=False))


def test_starts_are_draws_by_squared_distance_over_all_customers(spark, rfm):
    """The picks of a brute-force draw with the same uniform numbers."""
    scaled, _ = M.points(rfm)
    rows = sorted((r.customer_id, *(r[z] for z in G.Z)) for r in scaled.collect())
    ids, x = [r[0] for r in rows], np.array([r[1:] for r in rows])
    for s, got in enumerate(M.start_sequences(scaled, 4, 4)):
        picked = [x[np.argmin(M.uniform(ids, s, 0))]]
        for step in range(1, 4):
            d = np.min([((x - c) ** 2).sum(1) for c in picked], 0)
            with np.errstate(divide="ignore"):
                picked.append(x[np.argmin(-np.log(M.uniform(ids, s, step)) / d)])
        assert np.allclose(got, picked, rtol=1e-12)


def test_draw_frequencies_follow_the_weights():
    u = np.array([M.uniform(range(3), s, 1) for s in range(6000)])
    won = np.argmin(-np.log(u) / np.array([1.0, 2.0, 7.0]), 1)
    assert np.abs(np.bincount(won) / 6000 - [0.1, 0.2, 0.7]).max() < 0.02


def test_a_small_far_group_gets_a_start(spark):
    near = spark.range(100_000).selectExpr("id as customer_id", "cast(id % 97 as int) as recency", "id % 13 as frequency",
                                           "cast(id % 1009 as double) as monetary")
    far = spark.range(20).selectExpr("1000000 + id as customer_id", "cast(9000 as int) as recency", "900 + id as frequency",
                                     "cast(90000 as double) as monetary")
    scaled, _ = M.points(near.union(far))
    for centres in M.start_sequences(scaled, 10, 4):
        assert any(c[0] > 10 for c in centres)


def test_equal_customers_few_rows_and_empty_tables(spark):
    same = spark.createDataFrame([(i, 5, 1, 2.0) for i in range(6)], KIND)
    assert [r.cluster for r in M.kmeans_assigned(same, 3, 2).collect()] == [0] * 6
    sweep = M.kmeans_sweep(same, [2, 3], 2).collect()
    assert [(r.inertia, r.silhouette) for r in sweep] == [(0.0, None)] * 2
    assert M.kmeans_assigned(same.limit(0), 3, 2).count() == 0


def test_silhouette_against_all_pairs(spark, rfm):
    scaled, scale = M.points(rfm)
    x = np.array(scaled.select(*G.Z).collect(), float)
    for k, (centroids, _) in M.best_models(scaled, scale, [2, 3, 5], 2).items():
        lab = ((x[:, None] - np.array(centroids)[None]) ** 2).sum(2).argmin(1)
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        s = []
        for i in range(len(x)):
            a = d[i][lab == lab[i]].sum() / max((lab == lab[i]).sum() - 1, 1)
            b = min(d[i][lab == c].mean() for c in set(lab) - {lab[i]})
            s.append(0.0 if (lab == lab[i]).sum() == 1 else (b - a) / max(a, b))
        assert np.isclose(M.silhouettes(scaled, {k: centroids})[k], np.mean(s), rtol=1e-9)


def test_sums_of_large_integers_are_exact():
    import pyarrow as pa
    big = [2**52 + 1, 2**52 + 3, 5, 7]
    b = pa.record_batch({**{z: [0.0, 0.0, 9.0, 9.0] for z in G.Z}, "i_recency": [1, 2, 3, 4], "i_frequency": [1] * 4, "i_monetary": big})
    rows = next(M._sums({0: np.array([[0.0] * 3, [9.0] * 3])})(iter([b]))).to_pylist()
    assert [r["monetary"] for r in rows] == [big[0] + big[1], 12]


def test_customers_sit_at_their_nearest_centre(spark, rfm):
    found = M.kmeans_assigned(rfm, 3, 3)
    row = M.kmeans_violations(found).first()
    assert (row.customers, row.not_nearest, row.clusters) == (150, 0, 3)


def test_sweep_keeps_ten_starts(spark):
    import inspect

    from orderscope.queries import kmeans as Q
    assert Q.N_INIT == 10
    assert inspect.signature(M.kmeans_sweep).parameters["n_init"].default == 10
