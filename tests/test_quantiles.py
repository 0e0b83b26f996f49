import numpy as np
import pandas as pd
import pytest

from orderscope.plans.quantiles import medians, quantiles
from orderscope.plans.ranks import values_below

PROBS = [0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0, 0.25, 0.5, 0.75]


def _frame(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in [("a", 1), ("b", 2), ("c", 57), ("d", 400)]:
        if g == "d":
            vals = rng.integers(0, 4, n).astype(float)          # heavy ties
        else:
            vals = np.round(rng.zipf(1.6, n) * rng.random(n) * 50, 2)  # heavy tail
        rows += [(g, float(v)) for v in vals]
    return pd.DataFrame(rows, columns=["g", "x"])


@pytest.fixture(params=["direct", "radix"])
def path(request, monkeypatch):
    import orderscope.plans.quantiles as Q
    if request.param == "radix":
        monkeypatch.setattr(Q, "LEAF_MAX_DISTINCT", 3)
    return request.param


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_quantiles_bit_equal_to_pandas(spark, parts, path):
    pdf = _frame()
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(pdf).repartition(parts)
        res = quantiles(df, "x", PROBS, ["g"]).toPandas().set_index("g")
        med = medians(df, "x", ["g"]).toPandas().set_index("g")
        for g, sub in pdf.groupby("g"):
            assert np.array_equal(sub["x"].quantile(PROBS).to_numpy(), res.loc[g].to_numpy())
            assert sub["x"].median() == med.loc[g, "median"]
        glob = quantiles(df, "x", PROBS).toPandas().to_numpy()[0]
        assert np.array_equal(pdf["x"].quantile(PROBS).to_numpy(), glob)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_group_holding_a_third(spark, path):
    # one group holds a third of all rows; result stays exact
    rng = np.random.default_rng(7)
    hot = pd.DataFrame({"g": "hot", "x": np.round(rng.random(3000) * 1000, 2)})
    rest = pd.DataFrame({"g": [f"k{i % 50}" for i in range(6000)], "x": np.round(rng.random(6000) * 10, 2)})
    pdf = pd.concat([hot, rest], ignore_index=True)
    res = quantiles(spark.createDataFrame(pdf), "x", [0.25, 0.5, 0.75], ["g"]).toPandas().set_index("g")
    assert np.array_equal(res.loc["hot"].to_numpy(), hot["x"].quantile([0.25, 0.5, 0.75]).to_numpy())


def test_values_below_matches_sorted_counts(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.exponential(100, 500), 1)
    vc = pd.Series(x).value_counts().sort_index()
    df = spark.createDataFrame(pd.DataFrame({"v": vc.index.astype(float), "c": vc.values.astype("int64")}))
    got = values_below(df, "v", "c").toPandas().set_index("v").sort_index()
    assert (got["below"].to_numpy() == (vc.cumsum() - vc).to_numpy()).all()


def test_radix_on_clustered_values_with_outliers(spark, monkeypatch):
    # almost every value shares its first digits
    import orderscope.plans.quantiles as Q
    monkeypatch.setattr(Q, "LEAF_MAX_DISTINCT", 50)
    rng = np.random.default_rng(23)
    x = np.concatenate([np.round(rng.random(4000), 6), [1e12, -1e12, 3e11]])
    pdf = pd.DataFrame({"g": ["a"] * len(x), "x": x})
    res = quantiles(spark.createDataFrame(pdf), "x", PROBS, ["g"]).toPandas().set_index("g")
    assert np.array_equal(pdf["x"].quantile(PROBS).to_numpy(), res.loc["a"].to_numpy())
    med = medians(spark.createDataFrame(pdf), "x").toPandas().to_numpy()[0, 0]
    assert med == pdf["x"].median()


def test_values_below_splits_large_parts(spark, monkeypatch):
    import orderscope.plans.ranks as RK
    monkeypatch.setattr(RK, "LEAF_MAX_DISTINCT", 20)
    rng = np.random.default_rng(12)
    x = np.concatenate([np.round(rng.random(2000), 4), [1e9, 5e8, -1e9]])
    vc = pd.Series(x).value_counts().sort_index()
    df = spark.createDataFrame(pd.DataFrame({"v": vc.index.astype(float), "c": vc.values.astype("int64")}))
    got = values_below(df, "v", "c").toPandas().set_index("v").sort_index()
    assert (got["below"].to_numpy() == (vc.cumsum() - vc).to_numpy()).all()


def test_the_image_orders_as_the_values_do(spark):
    from orderscope.plans.radix import DIGITS, image, with_digits
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, 200), rng.normal(0, 1, 50) * 1e300, rng.normal(0, 1, 50) * 1e-310,
                        [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, 1.7976931348623157e308]])
    df = spark.createDataFrame(pd.DataFrame({"v": x})).distinct()
    rows = with_digits(df, "v").withColumn("image", image("v")).toPandas().sort_values("v")
    assert rows["image"].is_monotonic_increasing and len(set(rows["image"])) == len(set(x.tolist()))
    assert list(rows.sort_values(DIGITS)["image"]) == list(rows["image"])
    assert (rows[DIGITS[1:]].min() >= 0).all() and (rows[DIGITS[1:]].max() < 65536).all()


def test_radix_with_negative_values_ties_and_groups(spark, monkeypatch):
    import orderscope.plans.quantiles as Q
    import orderscope.plans.ranks as RK
    monkeypatch.setattr(Q, "LEAF_MAX_DISTINCT", 0)
    monkeypatch.setattr(RK, "LEAF_MAX_DISTINCT", 0)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1e-300, 300), np.round(rng.normal(0, 3, 700)), [1e250, -1e250]])
    pdf = pd.DataFrame({"g": rng.integers(0, 3, len(x)), "x": x})
    df = spark.createDataFrame(pdf)
    res = quantiles(df, "x", PROBS, ["g"]).toPandas().set_index("g")
    for g, sub in pdf.groupby("g"):
        assert np.array_equal(sub["x"].quantile(PROBS).to_numpy(), res.loc[g].to_numpy())
    vc = pdf.assign(x=pdf["x"] + 0.0).groupby(["g", "x"]).size().rename("c").reset_index()
    got = values_below(spark.createDataFrame(vc), "x", "c", ["g"]).toPandas().sort_values(["g", "x"])
    want = vc.sort_values(["g", "x"])
    assert (got["below"].to_numpy() == (want.groupby("g")["c"].cumsum() - want["c"]).to_numpy()).all()
    assert quantiles(df.limit(0), "x", [0.5], ["g"]).count() == 0
