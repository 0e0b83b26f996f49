"""Zero variance and zero denominators give values or NULL, never an error."""

from pyspark.sql import functions as F

from orderscope.operators import forecast as K
from orderscope.operators import hypothesis as J
from orderscope.operators import kpis as L
from orderscope.operators import segments as G

from .conftest import sales_frame


def test_constant_feature_is_scaled_by_one(spark):
    rfm = spark.createDataFrame([(1, 5, 1, 2.0), (2, 9, 1, 4.0)], "customer_id long, recency int, frequency long, monetary double")
    assert [r.frequency_z for r in G.rfm_scaled(rfm).collect()] == [0.0, 0.0]


def test_welch_of_one_row_or_equal_values_is_null(spark):
    for rows in ([(True, 5), (False, 6), (False, 9)], [(True, 5), (True, 5), (False, 5), (False, 5)], [(True, 5)]):
        r = J.welch_stats(spark.createDataFrame(rows, "f boolean, cents long"), "cents", "f").first()
        assert r.t is None


def test_mann_whitney_of_ties_is_null(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 3.0), (2, 3.0)], "sample int, monetary double")
    assert J.mann_whitney_stats(df).first().z is None


def test_constant_series_has_r2_of_one(spark):
    rows = [(i, 1, f"{2020 + i // 12}-{i % 12 + 1:02d}-15", "c", "p", 1, 10.0, "r", "ch") for i in range(30)]
    r = K.diagnostics(K.monthly_series(sales_frame(spark, rows))).first()
    assert r.r2 == 1.0 and r.resid_std == 0.0


def test_growth_over_an_empty_base_year_is_null(spark):
    rows = [(i, i, f"2000-{i % 12 + 1:02d}-15", "c", "p", 1, 10.0 + i, "r", "ch") for i in range(30)]
    sales = sales_frame(spark, rows)
    seg = spark.createDataFrame([(1, "Champions", 3, 2, 1.0)], "customer_id long, segment string, recency int, frequency long, monetary double")
    for df in (L.overview_kpis(sales, seg, 1999, 2000), L.project_summary(sales, seg, 1999, 2000)):
        assert df.select(F.col("yoy_pct")).first()[0] is None


def test_line_through_equal_x_has_no_slope(spark):
    df = spark.createDataFrame([(1, 4, 100), (2, 4, 300)], "customer_id long, frequency long, cents long")
    rows = J.fit_line(df, points=5).collect()
    assert len(rows) == 5 and all(r.x == 4.0 and r.slope is None and r.intercept is None and r.y is None for r in rows)
    assert {r.slope for r in J.fit_line(df.limit(0), points=5).collect()} == {None}
