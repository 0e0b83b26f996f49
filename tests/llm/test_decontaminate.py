import hashlib
import random

from orderscope.llm import decontaminate as D
from orderscope.llm.common import tune
from orderscope.llm.queries import QUERIES

from ..conftest import SF_SMALL
from . import brute


def expected(docs, items, window=13):
    index = {}
    for item, text in items:
        w = brute.alnum(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            index.setdefault(tuple(w[i:i + size]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in index}
    out = []
    for text in docs:
        w = brute.alnum(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (got := index.get(tuple(w[i:i + n]))):
                    hit.update(range(i, i + n))
                    found |= got
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_query_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op6_decontaminate"](spark, SF_SMALL).collect()}
    some = 0
    for d, (n, hit, found) in zip(docs, expected([d.text for d in docs], items), strict=True):
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
        some += r.contaminated
    assert some


def test_short_items_overlaps_blocks_and_odd_rows(spark, monkeypatch):
    tune(spark)
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "B", "c7", "é", "x"])
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 16)))) for i in range(12)]
    items += [(3, items[4][1]), (None, "q r s"), (50, None), (51, ""), (52, "only")]
    docs = [" ".join(word() for _ in range(rng.randint(0, 300))) for _ in range(40)]
    docs += [None, "", "Q, r; s! only", "q r", items[5][1] + "-" + items[6][1], docs[0]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, hits string")
    want = expected(docs, items)
    for size in (D.BLOCK_BYTES, 60):
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
        rows = sorted(D.decontaminate(df, bench).select("doc_id", "hits", D.covered().alias("n")).collect())
        assert [(r.hits.n_words, r.n, r.hits["items"]) for r in rows] == want
    assert D.decontaminate(df.limit(0), bench).count() == 0
    assert all(not r.hits.spans for r in D.decontaminate(df, bench.limit(0)).collect())


def test_several_blocks_keep_one_index_each(spark, monkeypatch):
    """Items of many blocks, a text with many copies, columns that bear internal names."""
    tune(spark)
    rng = random.Random(9)
    word = lambda: "w%d" % rng.randrange(40)
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(30)]
    docs = [" ".join([word(), items[i % 30][1], word()]) for i in range(40)] + [items[2][1]] * 50 + [None, "", "w1 w1"]
    df = spark.createDataFrame([(i, t, "k", "s") for i, t in enumerate(docs)], "doc_id long, text string, _key0 string, _spans0 string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    alive, most = [], []
    build = D.Index.__init__

    def counted(self, *args):
        build(self, *args)
        import gc
        import weakref
        gc.collect()
        alive.append(weakref.ref(self))
        most.append(sum(a() is not None for a in alive))
    monkeypatch.setattr(D.Index, "__init__", counted)
    monkeypatch.setattr(D, "BLOCK_BYTES", 400)
    found = D.decontaminate(df, bench, out="_hits")
    assert found.columns == [*df.columns, "_hits"]
    rows = sorted(found.select("doc_id", "_hits", "_key0", "_spans0", D.covered("_hits").alias("n")).collect())
    assert [(r["_hits"].n_words, r.n, r["_hits"]["items"]) for r in rows] == expected(docs, items)
    assert {(r["_key0"], r["_spans0"]) for r in rows} == {("k", "s")}
    assert len(alive) > 5 and max(most) <= 2  # the last one may still be named
