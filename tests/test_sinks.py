import tempfile

import pytest

from orderscope.sources.sinks import records, write_report


def test_write_report_round_trip(spark):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", 3.0)], "k int, s string, v double")
    out = tempfile.mkdtemp(prefix="orderscope-sink-") + "/r"
    write_report(df, out, partition_by=["s"])
    back = spark.read.parquet(out)
    assert sorted((r.k, r.s, r.v) for r in back.collect()) == [(1, "a", 2.5), (2, "b", 3.0)]
    assert records(df.orderBy("k"), 5)[0] == {"k": 1, "s": "a", "v": 2.5}
    with pytest.raises(ValueError):
        records(df, 1)


def test_build_sales_skip_equals_imputation_path(spark, monkeypatch):
    # with complete prices the imputation step is an exact no-op: skipping it
    # must give the same rows as running it
    from orderscope.sources import sales as S
    from .conftest import SF_SMALL
    assert S.prices_complete(spark, SF_SMALL)
    fast = sorted(map(tuple, S.build_sales(spark, SF_SMALL).collect()))
    monkeypatch.setattr(S, "prices_complete", lambda spark, sf: False)
    full = sorted(map(tuple, S.build_sales(spark, SF_SMALL).collect()))
    assert fast == full and len(fast) > 0
