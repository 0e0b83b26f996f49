import random

import numpy as np
import pytest

from orderscope.llm import near_dedup as N
from orderscope.llm.common import tune
from orderscope.llm.components import components
from orderscope.llm.queries import QUERIES

from ..conftest import SF_SMALL
from . import brute


def check(spark, texts):
    tune(spark)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute.groups(texts)
    for r in N.near_duplicates(df).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == want[r.doc_id][1])


def test_query_on_all_documents(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = brute.groups({r.doc_id: r.text for r in rows})
    got = QUERIES["op10_near_dedup"](spark, SF_SMALL).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_ids_beyond_the_broadcast_bound_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_IDS", 0)
    words = [f"w{i}" for i in range(80)]
    check(spark, {i: " ".join(words[:40] + [f"x{i}"] + words[40 + i % 3:]) for i in range(12)})


def test_chains_copies_and_many_documents_that_share_half(spark):
    """A drifting chain (ends far apart), exact copies, short texts, and a crowd
    that shares a passage (large mixed buckets without links)."""
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(100_000)
    texts, i = {}, 0
    chain = [word() for _ in range(200)]
    for _ in range(30):
        texts[i] = " ".join(chain)
        chain[rng.randrange(200)] = word()
        chain = chain[3:] + [word() for _ in range(3)]
        i += 1
    for _ in range(20):
        texts[i] = texts[5]
        i += 1
    passage = [word() for _ in range(130)]
    for _ in range(90):
        texts[i] = " ".join(passage + [word() for _ in range(60)])
        i += 1
    for t in ["", None, "one", "one", "Two words", "two  words\n", "a b c d", "a b c d e", "A B C D E f"]:
        texts[i] = t
        i += 1
    order = list(texts)
    rng.shuffle(order)
    check(spark, dict(zip(order, texts.values(), strict=True)))


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.concatenate([a[:2400], np.unique(rng.integers(0, 2**63, 600).astype(np.uint64))])
    ra, rb, rc = N.registers([a, b, np.union1d(a, b)])
    assert (N.merged(ra, rb) == rc).all()
    got = N.similarity(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(got - 2400 / 3600) < 0.15
    assert (N.registers([np.zeros(0, np.uint64)]) == 0).all()


def test_nulls_repeats_empty_and_extra_columns(spark):
    tune(spark)
    df = spark.createDataFrame([(1, "a b c", 1), (1, "a b c", 1), (None, "a b c", 0), (2, None, 0), (3, "", 0)],
                               "doc_id long, text string, n_shingles int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept)
                 for r in N.near_duplicates(df).collect())
    assert got == [(False, 1, 1, 1, True)] * 2 + [(False, 2, 0, 2, True), (False, 3, 0, 3, True), (True, 0, 1, None, True)]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_an_id_repeated_many_times_and_with_several_texts(spark):
    """Repeated rows are one set; an id links by any of its texts."""
    tune(spark)
    words = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join(words[:k] + ["x"] + words[k + 1:])
    rows = [(1, " ".join(words))] * 300 + [(2, near(30))] * 200 + [(3, near(10)), (3, "other text of one id here"),
                                                                   (4, "other text of one id here"), (5, "alone")]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.component_id)
    assert by_id == {1: {1}, 2: {1}, 3: {1}, 4: {1}, 5: {5}}


def test_components_of_a_path(spark):
    n = 40
    ids = list(range(n))
    random.Random(2).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {k: 0 for k in range(1, n)} | {101: 100}


@pytest.fixture()
def low_thresholds(spark):
    """Joins of small tables behave like those of large ones: shuffled, and split where skewed."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0", "spark.sql.shuffle.partitions": "16",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # a split needs several map tasks
    old = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _splits(df):
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_links_of_one_hub_are_split(spark, low_thresholds):
    from pyspark.sql import functions as F

    from orderscope.llm import components as C
    from orderscope.llm.common import written
    hub = written(spark.range(1, 200_001, numPartitions=8).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v")), "hub")
    moved = C._largest(hub)
    rows = moved.collect()
    assert len(rows) == 200_000 and all(r.v == 0 for r in rows)
    assert _splits(moved)
    assert C.components(hub, "u", "v").agg(F.count("*"), F.max("label")).first() == (200_000, 0)


def test_rows_of_one_crowded_bucket_are_split(spark, low_thresholds, monkeypatch):
    """A bucket with a third of all rows, in the joins with the buckets' hubs and main labels."""
    from pyspark.sql import functions as F

    joined = []

    def kept(df, name):
        if name in ("dedup-members", "dedup-mixed"):
            rows = df.collect()
            joined.append((name, len(rows), _splits(df)))
        return plain(df, name)

    plain = N.written
    monkeypatch.setattr(N, "written", kept)
    n = 150_000
    keyed = plain(spark.range(n, numPartitions=8).select(
        "id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.floor(F.col("id") / 6)).cast("long").alias("key")), "keyed")
    members = N._members(keyed)
    assert members.where("key = -1").agg(F.count("*"), F.max("hub")).first() == (n // 3, 0)
    links = N._Links(None, None, 75)
    links.labels = plain(keyed.where("id % 3 = 0").selectExpr("id AS node", "id - id % 300 AS label"), "names")
    mixed = N._mixed(members, links)
    assert mixed.where("key = -1").agg(F.count("*"), F.min("main"), F.max("main")).first() == (n // 3, 0, 0)
    assert joined == [("dedup-members", members.count(), True), ("dedup-mixed", mixed.count(), True)]
