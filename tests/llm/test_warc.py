import gzip
import hashlib
import io

import pytest

from orderscope.llm import warc as W
from orderscope.llm.common import shared_path, tune
from orderscope.llm.files import opened
from orderscope.llm.queries import ORACLES, QUERIES

from ..conftest import SF_SMALL
from .oracle import same


def test_query_matches_sql(spark):
    assert same(spark, QUERIES["op7_warc"], ORACLES["op7_warc"], SF_SMALL)


def test_round_trip_of_odd_rows(spark, monkeypatch):
    tune(spark)
    big = "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 20
    rows = [(5, "http://a\r\nX: y", big, 1), (3, "http://é/", big, 1), (3, "http://é/", big, 1), (9, None, big, 1), (1, "u", "short", 1),
            (2, "u", "short", 1), (4, "", None, 1), (None, "n", big, 1), (7, "z", "x" * 99, 1), (8, "z", "x" * 99, 1), (10, "e", "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int").coalesce(2)
    monkeypatch.setattr(W, "ROTATE", 3000)
    made, index = W.normalise(W.write(W.deduplicated(df)))
    key = lambda r: (r.page_id is None, r.page_id or 0)
    got = sorted(W.read(made, index).collect(), key=key)
    for r, (page, _, html, _) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        raw = (html or "").encode()
        revisit = html == big and page != 3
        assert (r.page_id, r.record_type, r.refers_to) == (page, "revisit" if revisit else "response", 3 if revisit else None)
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert bytes(r.payload) == (b"" if revisit else raw)
    assert made.count() > 2
    for e in spark.read.schema(W.INDEX).json(index).collect():  # every entry is a member of its own
        with opened(e.archive, "r") as f:
            assert gzip.decompress(f.read_at(e.length, e.offset)).startswith(b"WARC/1.1\r\nWARC-Type: " + e.record_type.encode())
    none, at = W.normalise(W.write(W.deduplicated(df.limit(0))))
    assert W.read(none, at).count() == 0


def test_normaliser_takes_any_stream(spark):
    one = [W.record(i, "u", "p" * i, i, "d", None) for i in range(300)]
    for raw in (gzip.compress(b"".join(one)), b"".join(map(gzip.compress, one)), b"".join(one)):
        assert [r for r, _ in W.records(W.inflated(io.BytesIO(raw)))] == one
    for cut in (gzip.compress(b"".join(one))[:-20], b"".join(one)[:-5]):
        with pytest.raises((ValueError, EOFError)):
            list(W.records(W.inflated(io.BytesIO(cut))))
    path = shared_path(spark, "given") + "/x.warc.gz"
    with opened(path, "w") as f:
        f.write(gzip.compress(b"".join(one)))
    made, index = W.normalise(spark.createDataFrame([(path,)], "path string"))
    assert sorted(r.page_id for r in W.read(made, index).collect()) == list(range(300))
