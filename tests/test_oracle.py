"""Spark vs the DuckDB oracle on sf0.001 (one query per family by default;
ORDERSCOPE_FULL_ORACLE=1 runs every registered query)."""

import os

import duckdb
import pytest

from orderscope.registry import load_all

from .conftest import SF_SMALL

SUBSET = ["monthly_sales", "clean_sales", "describe_numeric", "revenue_histogram", "category_product_rollup",
          "rfm_scores", "quintile_fallback", "cohort_retention", "revenue_forecast", "welch_q4",
          "mannwhitney_channel_ltv", "segment_summary", "project_summary", "time_features"]

REG = load_all()
NAMES = [n for n, e in REG.items() if e.sql] if os.environ.get("ORDERSCOPE_FULL_ORACLE") else SUBSET


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _rows(tbl):
    cols = sorted(tbl.column_names)
    rows = [tuple(r[c] for c in cols) for r in tbl.select(cols).to_pylist()]
    return cols, sorted(rows, key=lambda r: tuple((v is None, repr(v)) for v in r))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    e = REG[name]
    sp = e.run(spark, SF_SMALL).toArrow()
    dk = con.sql(e.oracle()).to_arrow_table()
    assert _rows(sp) == _rows(dk)


def test_entry_contract(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["year_month", "revenue", "orders", "customers", "aov"]
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60
