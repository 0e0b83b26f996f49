import zlib

import numpy as np
import pyarrow as pa

from orderscope.llm import quality as Q
from orderscope.llm.common import tune
from orderscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_one_row_a_document(spark):
    rows = QUERIES["op2_pu_quality"](spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_prior_and_risk_on_known_mixtures():
    rng = np.random.default_rng(0)
    good = lambda n: rng.normal(2, 1, (n, Q.WIDTH)) * (np.arange(Q.WIDTH) < 3)
    bad = lambda n: rng.normal(-2, 1, (n, Q.WIDTH)) * (np.arange(Q.WIDTH) < 3)
    for share in (0.3, 0.8):
        n = int(4000 * share)
        m = Q.train(good(2000).astype(np.float32), np.concatenate([good(n), bad(4000 - n)]).astype(np.float32))
        assert abs(m.prior - share) < 0.06
        assert (m.score(good(500)) > 0.5).mean() > 0.97 and (m.score(bad(500)) < 0.5).mean() > 0.97


def test_features_of_a_text_do_not_depend_on_its_batch():
    texts = ["", None, "a", "One two two\nthree!", "é" * 50, "x | y | z\n" * 30, "\n"]
    whole = Q.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.array_equal(whole[i], Q.features(pa.array([t], pa.string()))[0])
    assert not whole[0].any() and not whole[1].any()


def test_nulls_repeats_no_labels_and_clashing_columns(spark):
    tune(spark)
    df = spark.createDataFrame([(1, "good text", "x"), (1, "good text", "x"), (None, None, None), (2, "", "")],
                               "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        rows = Q.score(df, Q.fit(df, some)).collect()
        assert len(rows) == 4 and rows[0].score == rows[1].score and all(0 <= r.score <= 1 for r in rows)
        assert rows[2].score == rows[3].score
    assert Q.score(df.limit(0), Q.fit(df.limit(0), labels)).count() == 0


def test_risk_and_gradient_against_a_plain_version_and_finite_differences():
    rng = np.random.default_rng(7)
    p, u, w = rng.normal(1, 1, (20, 5)), rng.normal(0, 1, (40, 5)), rng.normal(0, 0.5, 6)
    logistic = lambda z: np.log1p(np.exp(-z))
    f = lambda x, w: x @ w[:5] + w[5]
    tilt = (0.3, rng.normal(0, 1, 6), rng.normal(0, 1, 6))
    for extra in (None, tilt):
        first, negative, up, down = Q.risk(w, p, u, 0.4, 0.01, extra)
        assert np.isclose(first, 0.4 * np.mean([logistic(z) for z in f(p, w)]) + 0.005 * (w[:5] ** 2).sum())
        want = np.mean([logistic(-z) for z in f(u, w)]) - 0.4 * np.mean([logistic(-z) for z in f(p, w)])
        assert np.isclose(negative, want + (0 if extra is None else 0.3 + tilt[1] @ (w - tilt[2])))
        for i in range(6):
            e = 1e-6 * (np.arange(6) == i)
            a, b = Q.risk(w + e, p, u, 0.4, 0.01, extra), Q.risk(w - e, p, u, 0.4, 0.01, extra)
            assert abs((a[0] - b[0]) / 2e-6 - up[i]) < 1e-6 and abs((a[1] - b[1]) / 2e-6 - down[i]) < 1e-6


def test_best_bin_against_a_loop():
    rng = np.random.default_rng(8)
    sp, su = rng.integers(0, 30, 50) / 30, rng.integers(0, 30, 80) / 30
    err = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(50) + 1 / np.sqrt(80))
    best = min(((np.mean(su >= c) + err) / np.mean(sp >= c), np.mean(su >= c) / np.mean(sp >= c)) for c in {*sp, *su} if np.mean(sp >= c))
    assert np.isclose(Q.best_bin(sp, su), np.clip(best[1], 0.02, 0.98))
    values, n = np.unique(su, return_counts=True)
    assert np.isclose(Q.best_bin(sp, values, n), Q.best_bin(sp, su))


def test_unlabelled_terms_cover_every_row(spark):
    tune(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id as id", "text")
    rng = np.random.default_rng(9)
    model = Q.Model(rng.normal(0, 0.1, Q.WIDTH), np.ones(Q.WIDTH), rng.normal(0, 0.1, Q.WIDTH), 0.1, 0.5)
    x = Q.features(docs.toArrow()["text"].combine_chunks())
    z = ((x - model.mean) / model.scale).clip(-8, 8) @ model.weights + model.bias
    n, value, slope = Q.Every(docs.repartition(5)).terms(model)
    g = 1 / (1 + np.exp(-z))
    assert n == len(x) and np.isclose(value, np.log1p(np.exp(z)).mean())
    assert np.allclose(slope, np.append(((x - model.mean).clip(-8, 8) * g[:, None]).mean(0), g.mean()))
    bins, rows = Q.Every(docs).scores(model)
    assert 0 < rows.sum() < n and set(bins) <= set(Q._bins(model.score(x)))
    assert Q.Every(docs.limit(0)).terms(model)[0] == 0 and not Q.Every(docs.limit(0)).scores(model)[1].sum()


def test_a_small_sample_still_minimises_the_risk_of_all_rows(spark):
    """The gradient of the whole table's risk at the fitted weights, with and without the passes over it."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    tune(spark)
    whole = {r.doc_id: r.s for r in Q.score(docs, Q.fit(docs, labels), out="s").collect()}
    few = {r.doc_id: r.s for r in Q.score(docs, Q.fit(docs, labels, sample=200), out="s").collect()}
    assert np.mean([(whole[k] >= 0.7) == (few[k] >= 0.7) for k in whole]) > 0.93
