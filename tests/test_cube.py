"""Every choice of the dashboard's two filters equals the direct scan, and reads no order."""

import pytest

from orderscope.operators import cube as C
from orderscope.operators.trends import revenue_trend
from orderscope.queries.cube import _cube
from orderscope.registry import load_all
from orderscope.sources.sales import load_sales

from .conftest import SF_SMALL, sales_frame


def _rows(df):
    return sorted(map(tuple, df.select("year_month", "revenue", "rolling_revenue").collect()))


def test_every_choice_equals_the_direct_scan(spark):
    rows = [(i, i % 5, f"{2020 + i % 3}-{1 + i * 7 % 12:02d}-{1 + i % 28:02d}", "abc"[i % 7 % 3], "p", 1 + i % 4, 1.25 * i, "r", "x")
            for i in range(1, 200)]
    sales = sales_frame(spark, rows + [(900, 1, "2021-03-03", None, "p", 1, 5.0, "r", "x")])
    cube = C.sales_cube(sales)
    every = C.every_trend(cube)
    for category in ("All", "a", "b", "c"):
        for year in ("All", "2020", "2021", "2022"):
            direct = _rows(revenue_trend(sales, category, None if year == "All" else int(year)))
            assert direct and _rows(C.trend_of(cube, category, year)) == direct
            assert _rows(every.where((every.category_choice == category) & (every.year_choice == year))) == direct
    assert [r.revenue for r in every.where("category_choice IS NULL AND year_choice = 'All'").collect()] == [5.0]
    values = {tuple(r) for r in C.choices(cube).collect()}
    assert values == {("category", c) for c in ("a", "b", "c", None)} | {("year", y) for y in ("2020", "2021", "2022")}


def test_empty_sales_and_unknown_choices(spark):
    sales = sales_frame(spark, [(1, 1, "2021-03-03", "a", "p", 1, 5.0, "r", "x")])
    cube = C.sales_cube(sales)
    assert C.trend_of(cube, "none").count() == C.trend_of(cube, "a", 1999).count() == 0
    empty = C.sales_cube(sales.limit(0))
    assert C.every_trend(empty).count() == C.choices(empty).count() == 0


@pytest.mark.parametrize("name", ["trend_every_filter", "trend_filtered_cube", "filter_values_cube"])
def test_no_choice_reads_the_sales_files(spark, name):
    files = load_all()[name].run(spark, SF_SMALL).inputFiles()
    assert files and all("-cube-1/" in f for f in files)
    assert _cube(spark, SF_SMALL).count() <= load_sales(spark, SF_SMALL).select("category").distinct().count() * 12 * 10
