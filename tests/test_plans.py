"""Plan-shape tests: what Catalyst must (not) produce for the registered queries."""

import pytest

from orderscope.registry import load_all

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString() if hasattr(df, "_jdf") else ""


@pytest.fixture(scope="module")
def reg():
    return load_all()


def test_no_python_worker_in_the_analyses(spark, reg):
    for name in ["monthly_sales", "rfm_scores", "cohort_retention", "revenue_forecast", "welch_weekend_aov",
                 "segment_summary", "category_boxplot", "hypothesis_report"]:
        p = _plan(reg[name].run(spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_channel_membership_is_one_aggregate_per_customer(spark, reg):
    # membership ("ever ordered via the channel") is a per-customer flag
    # aggregate joined once with the customer table; the channel filter
    # reaches the scan and sales is read once
    p = _plan(reg["channel_ltv"].run(spark, SF_SMALL))
    assert "In(channel, [1-URGENT,5-LOW])" in p
    assert "keys=[customer_id" in p and "functions=[partial_max(" in p
    assert p.count("FileScan parquet") == 1


def test_filters_and_columns_reach_the_scan(spark, reg):
    df = reg["revenue_trend_filtered"].run(spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    pushed = p[p.index("PushedFilters"):]
    assert "EqualTo(category,ECONOMY)" in pushed
    assert "GreaterThanOrEqual(order_" in pushed  # the year filter is a pushed date range
    # only the needed columns are read from the materialised sales table
    assert "ReadSchema: struct<order_date:date,category:string,cents:bigint>" in p
    assert "PartitionFilters: [isnotnull(order_year" in p and "(order_year" in p  # other years' folders are not read


def test_source_scans_are_pruned(spark):
    from orderscope.sources.sales import build_sales
    p = build_sales(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<r_regionkey:int,r_name:string>" in p
    assert "l_discount" not in p and "c_acctbal" not in p


def test_monthly_windows_run_after_aggregation(spark, reg):
    # the un-partitioned window of E2 sits above the monthly aggregate, never on sales rows
    p = reg["rolling_revenue"].run(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    w = p.index("Window")
    assert "Aggregate" in p[w:]


def test_layout_invariance(spark, reg):
    outs = []
    for parts in ("1", "7", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        outs.append(sorted(map(tuple, reg["rfm_scores"].run(spark, SF_SMALL).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert outs[0] == outs[1] == outs[2]


def test_sales_is_scanned_once(spark, reg):
    # small intermediates (monthly series, per-customer table, rollup rows) are
    # written once (that job is the one scan), so no branch of the final plan
    # reads sales again
    for name in ["revenue_forecast", "forecast_by_category", "forecast_diagnostics", "overview_kpis",
                 "category_product_rollup", "rfm_scores", "channel_ltv", "filter_values",
                 "cohort_retention", "pearson_freq_ltv", "revenue_histogram", "category_boxplot",
                 "weekend_density"]:
        p = _plan(reg[name].run(spark, SF_SMALL))
        assert p.count("FileScan parquet") <= 1, name


def test_segments_join_no_customers(spark, reg):
    p = _plan(reg["segment_summary"].run(spark, SF_SMALL))
    assert "SortMergeJoin" not in p and "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
    assert "[customer_id" not in p[p.index("HashAggregate"):].split("keys=[segment")[0]
