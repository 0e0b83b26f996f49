"""The written ``sales`` table follows its sources and is never read half-done."""

import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from orderscope.sources import sales as S

from .conftest import SF_SMALL


@pytest.fixture()
def copy(tmp_path):
    for t in S.SOURCE_TABLES:
        shutil.copyfile(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")  # not the read-only mode
    return f"file://{tmp_path}"


def test_a_changed_file_uri_source_is_built_again(spark, copy):
    whole = S.load_sales(spark, copy).count()
    base = S.sales_path(spark, copy)
    assert S.materialize_sales(spark, copy) == S.materialize_sales(spark, copy)
    lines = pq.read_table(path := f"{copy.removeprefix('file://')}/lineitem.parquet")
    pq.write_table(lines.slice(0, len(lines) // 2), path)
    assert S.sales_path(spark, copy) != base
    half = S.load_sales(spark, copy).count()
    assert 0 < half < whole and half == S.build_sales(spark, copy).count()


def test_a_folder_without_its_marker_is_not_read(spark, copy):
    base = S.sales_path(spark, copy)
    S.with_year(S.build_sales(spark, copy).limit(100)).write.partitionBy("order_year").parquet(f"{base}/data-dead")
    assert S.load_sales(spark, copy).count() == S.build_sales(spark, copy).count() > 100


def test_read_errors_are_not_taken_for_a_missing_table(spark, copy):
    path = S.materialize_sales(spark, copy)
    for folder, _, files in os.walk(path.removeprefix("file:")):
        for f in files:
            if f.endswith(".parquet"):
                with open(f"{folder}/{f}", "wb") as out:
                    out.write(b"broken")
    with pytest.raises(Exception):  # noqa: B017 - Spark's own read error
        S.load_sales(spark, copy).agg({"cents": "sum"}).collect()


def test_null_prices_are_imputed_through_build_sales(spark, copy):
    part = pq.read_table(path := f"{copy.removeprefix('file://')}/part.parquet")
    prices = [None if k % 10 == 3 else x for k, x in zip(part["p_partkey"].to_pylist(), part["p_retailprice"].to_pylist(), strict=True)]
    k = part.schema.get_field_index("p_retailprice")
    pq.write_table(part.set_column(k, part.schema.field(k), pa.array(prices, part.schema.field(k).type)), path)
    assert not S.prices_complete(spark, copy)
    got = S.build_sales(spark, copy)
    raw = S.dedup_keep_first(S.sales_raw(spark, copy, with_tiebreak=True), ["order_id"], S.TIEBREAK)
    gaps = raw.where("unit_price IS NULL").count()
    assert gaps > 0 and got.where("unit_price IS NULL").count() == 0
    med = raw.groupBy("category").agg({"unit_price": "median"}).toPandas().set_index("category").iloc[:, 0]
    filled = got.join(raw.where("unit_price IS NULL").select("order_id"), "order_id").toPandas()
    assert len(filled) and all(abs(r.unit_price - med[r.category]) < 1e-9 for r in filled.itertuples())
