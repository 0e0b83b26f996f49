import random

import pytest

from orderscope.llm import licenses as L
from orderscope.llm.common import tune
from orderscope.llm.queries import QUERIES

from ..conftest import SF_SMALL
from . import brute


def expected(text, percent=90, templates=L.TEMPLATES):
    w = brute.alnum(text)
    places = []
    for phrase, label in L.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    blocks = []
    for start in range(0, len(w), L.STEP):
        own = set(w[start:start + L.BLOCK])
        for t, label in templates:
            want = set(t.split())
            if 100 * len(want & own) >= percent * len(want):
                blocks.append((label, start, min(start + L.BLOCK, len(w)), len(want & own) / len(want)))
    return len(w), sorted(places), sorted(blocks)


def found(row):
    return (row.n_words, sorted((p.word, p.label) for p in row.places),
            sorted((b.label, b.start, b.end, b.containment) for b in row.blocks))


def test_query_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op5_license_scan"](spark, SF_SMALL).collect()}
    seen = set()
    for d in docs:
        r, (n, places, blocks) = got[d.doc_id], expected(d.text)
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        base = {x[1] for x in places}
        assert r.base_labels == ",".join(sorted(base))
        assert r.labels == ",".join(sorted(base | {b[0] for b in blocks}))
        assert r.score == (1.0 if places else max((b[3] for b in blocks), default=0.0))
        seen |= set(r.labels.split(","))
    assert {"mit", "apache-2", "cc-by-nc"} <= seen


@pytest.mark.parametrize("percent", [100, 90, 70])
def test_join_equals_brute_force(spark, percent):
    tune(spark)
    rng = random.Random(percent)
    words = " ".join(t for t, _ in L.TEMPLATES).split() + ["x", "y", "é"]
    docs = [None, "", "MIT", "under the MIT, license"]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(0, 6)):
            t = rng.choice(L.TEMPLATES)[0].split()
            parts += [x for x in t if rng.random() < 0.93] + [rng.choice(words) for _ in range(rng.randint(0, 40))]
        docs.append(" ".join(parts))
    docs.append(docs[-1])
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, licenses int")
    rows = sorted(L.scan(df, percent=percent).select("doc_id", "licenses.*").collect())
    assert [found(r) for r in rows] == [expected(t, percent) for t in docs]
    assert L.scan(df.limit(0)).count() == 0
