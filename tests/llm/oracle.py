"""A query against its DuckDB SQL on the same tables."""

import os

import duckdb

TABLES = ["documents", "pages", "benchmark", "labels", "conversations"]


def rows(tbl):
    cols = sorted(tbl.column_names)
    return cols, sorted((tuple(r[c] for c in cols) for r in tbl.select(cols).to_pylist()), key=repr)


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return rows(query(spark, sf_dir).toArrow()) == rows(con.sql(sql).to_arrow_table())
