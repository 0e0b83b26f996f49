"""The lines that ``sales`` keeps, and what their shuffles carry."""

import datetime as dt
import random

import pytest

from orderscope.sources import sales as S

from .conftest import SF_SMALL


def tables(spark, path, numbers):
    rng = random.Random(len(numbers))
    pick = lambda *values: rng.choice(values)
    day = [dt.datetime(1999, 1, d, h) for d in (1, 2) for h in (0, 7)]
    lines = [(pick(-3, 0, 1, 2, 3, 4, None), rng.choice(numbers), pick(*[0, 1, 2] * 9, None), pick(1, 2, None),
              pick(1.0, 1.5, 2.0, 2.25, None),
              pick(1.0, 2.0, None), rng.choice([*day * 9, None])) for _ in range(300)]
    made = {
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                            "l_extendedprice double, l_shipdate timestamp"),
        "orders": ([(k, k % 2, dt.datetime(1999, 1, 5 + k), f"p{k}") for k in (-3, 0, 1, 2, 3)],
                   "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string"),
        "part": ([(k, f"t{k}", f"n{k}", 10.0 + k) for k in range(3)], "p_partkey long, p_type string, p_name string, p_retailprice double"),
        "customer": ([(0, 0), (1, 1)], "c_custkey long, c_nationkey int"),
        "nation": ([(0, 0), (1, 1)], "n_nationkey int, n_regionkey int"),
        "region": ([(0, "A"), (1, "B")], "r_regionkey int, r_name string")}
    for name, (rows, kind) in made.items():
        spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return f"file://{path}"


@pytest.mark.parametrize("numbers", [range(10), [0, 1, 9, 10, 12, -1], [1, 2, None]])
def test_the_first_line_of_every_order_id_is_kept(spark, tmp_path, numbers):
    sf = tables(spark, tmp_path, numbers)
    assert S.line_numbers_fit(spark, sf) == (numbers == range(10))
    whole = S._enrich(spark, sf, S.dedup_keep_first(S._lines(spark, sf), ["order_id"], S.TIEBREAK))
    want = sorted(map(str, whole.select(*S.FACT_COLUMNS).collect()))
    lines = S._enrich(spark, sf, S.unique_lines(spark, sf))
    assert len(want) > 3 and sorted(map(str, lines.select(*S.FACT_COLUMNS).collect())) == want


def test_lines_cross_two_exchanges_without_their_prices(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.build_sales(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "l_extendedprice" not in plan
    # orders by customer, customers; lines and orders by order; lines and parts by part
    assert plan.count("Exchange hashpartitioning") == 6 and "hashpartitioning(order_id" not in plan


def test_files_of_a_year_are_sorted_by_date(spark):
    from pyspark.sql import functions as F
    sales = S.load_sales(spark, SF_SMALL)
    at = sales.select(F.input_file_name().alias("file"), "order_year", "order_date", "order_id").toPandas()
    assert len(at) and (at.order_year == [d.year for d in at.order_date]).all()
    assert all(list(zip(g.order_date, g.order_id, strict=True)) == sorted(zip(g.order_date, g.order_id, strict=True))
               for _, g in at.groupby("file", sort=False))
