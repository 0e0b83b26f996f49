import datetime as dt

from pyspark.sql import functions as F

from orderscope.operators import cohorts as C
from orderscope.operators import trends as T
from orderscope.operators.breakdowns import category_mix_by_year, category_product_rollup
from orderscope.operators.quality import dedup_orders

from .conftest import sales_frame


def _monthly(spark, months_cents):
    return spark.createDataFrame([(dt.date.fromisoformat(m), c) for m, c in months_cents],
                                 "year_month date, cents bigint")


def test_short_rolling_strict_and_relaxed(spark):
    # FIXTURES "short_rolling": 1,2,3,4 -> strict null,null,2,3 ; relaxed 1,1.5,2,3
    m = _monthly(spark, [("2024-01-01", 100), ("2024-02-01", 200), ("2024-03-01", 300), ("2024-04-01", 400)])
    strict = [r.rolling_revenue for r in T.rolling_mean(m, 3).orderBy("year_month").collect()]
    relaxed = [r.rolling_revenue for r in T.rolling_mean(m, 3, 1).orderBy("year_month").collect()]
    assert strict == [None, None, 2.0, 3.0]
    assert relaxed == [1.0, 1.5, 2.0, 3.0]


def _sales(spark, rows):
    return sales_frame(spark, [(i, cust, d, "c", "p", 1, price, "r", "ch")
                               for i, (cust, d, price) in enumerate(rows)])


def test_growth_is_positional_and_zero_safe(spark):
    # FIXTURES "gap_month" (Jan, Feb, Apr) and "zero_month" (0 then 5)
    s = _sales(spark, [(1, "2024-01-10", 10.0), (1, "2024-02-10", 20.0), (1, "2024-04-10", 30.0)])
    g = T.mom_growth(s).orderBy("year_month").collect()
    assert [r.mom_growth_pct for r in g] == [None, 100.0, 50.0]
    assert [r.direction for r in g] == [None, "up", "up"]
    z = _sales(spark, [(1, "2024-01-10", 0.0), (1, "2024-02-10", 5.0)])
    z = z.withColumn("cents", F.when(F.col("revenue") == 0, F.lit(0).cast("bigint")).otherwise(F.col("cents")))
    g2 = T.mom_growth(z).orderBy("year_month").collect()
    assert g2[1].mom_growth_pct is None


def test_sparse_cohort_is_not_zero_filled(spark):
    # FIXTURES "sparse_cohort": cohort A has no buyer at age 2
    s = _sales(spark, [(1, "2024-01-05", 5.0), (1, "2024-02-05", 5.0), (1, "2024-03-05", 5.0),
                       (2, "2024-01-07", 5.0), (2, "2024-02-07", 5.0),
                       (3, "2024-02-01", 5.0), (3, "2024-04-01", 5.0)])
    counts = C.cohort_counts(s)
    ret = C.cohort_retention(counts)
    rows = {(r.cohort_month.isoformat(), r.cohort_index): r.retention for r in ret.collect()}
    assert rows[("2024-01-01", 0)] == 1.0 and rows[("2024-01-01", 1)] == 1.0
    assert rows[("2024-01-01", 2)] == 0.5
    assert ("2024-02-01", 1) not in rows and rows[("2024-02-01", 2)] == 1.0
    curve = {r.cohort_index: r.avg_retention_pct for r in C.retention_curve(ret).collect()}
    assert curve[0] == 100.0 and curve[1] == 100.0 and curve[2] == 75.0


def test_dedup_keeps_first_and_is_idempotent(spark):
    rows = [(7, 1, "2024-01-02", "c", "p", 1, 1.0, "r", "x"), (7, 1, "2024-01-01", "c", "p", 2, 1.0, "r", "y"),
            (8, 2, "2024-01-03", "c", "p", 3, 1.0, "r", "z")]
    df = sales_frame(spark, rows)
    once = dedup_orders(df)
    assert {r.order_id: r.channel for r in once.collect()} == {7: "y", 8: "z"}
    assert sorted(map(tuple, dedup_orders(once).collect())) == sorted(map(tuple, once.collect()))


def test_dedup_hot_key_holding_a_third(spark):
    hot = [(1, 1, "2024-01-01", "c", "p", q, 1.0, "r", "x") for q in range(1, 3001)]
    rest = [(i + 2, 1, "2024-01-01", "c", "p", 1, 1.0, "r", "x") for i in range(6000)]
    out = dedup_orders(sales_frame(spark, hot + rest))
    assert out.count() == 6001
    assert out.where("order_id = 1").collect()[0].quantity == 1


def test_shares_sum_to_100_and_rollup_leaves_sum_to_total(spark):
    s = _sales(spark, [(1, "2023-01-05", 5.0), (2, "2023-02-05", 15.0), (1, "2024-03-05", 7.5)])
    s = s.withColumn("category", F.when(F.col("customer_id") == 1, "a").otherwise("b"))
    mix = category_mix_by_year(s).groupBy("year").agg(F.sum("share_pct").alias("t")).collect()
    assert all(abs(r.t - 100.0) < 1e-9 for r in mix)
    r = category_product_rollup(s).collect()
    total = [x.revenue for x in r if x.level == "total"][0]
    assert abs(sum(x.revenue for x in r if x.level == "product") - total) < 1e-9
