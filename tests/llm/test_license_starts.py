import random

import pyarrow as pa
import pytest

from orderscope.llm import licenses as L

from . import brute

NOTICE = L.TEMPLATES[1][0].split()


def expected(text, templates, percent):
    """Every start, with the window of each template."""
    w, out = brute.alnum(text), []
    for t, label in templates:
        want, size = set(t.split()), L.window(len(t.split()))
        for start in range(len(w)):
            own = want & set(w[start:start + size])
            if 100 * len(own) >= percent * len(want):
                out.append((label, start, min(start + size, len(w)), len(own) / len(want)))
    return sorted(out)


def found(rows):
    return [sorted((b["label"], b["start"], b["end"], b["containment"]) for b in r["blocks"]) for r in rows.to_pylist()]


@pytest.mark.parametrize("before", [0, 1, 17, 18, 31, 32, 50])
def test_notice_spread_over_60_words_at_any_place(before):
    spread = [x for k, word in enumerate(NOTICE) for x in (word, *[f"x{k}"] * (1 + (k % 15 == 7)))]
    assert len(spread) == 60
    rows = L.Join(L.TEMPLATES, L.PHRASES, {}, 90).rows(pa.array([" ".join(["y"] * before + spread + ["z"] * 40)]))
    assert "mit" in {b[0] for b in found(rows)[0]}


def test_single_paragraphs_of_full_texts(spark):
    docs = [t for t, _ in L.PARAGRAPHS]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: set(r.labels) for r in L.scan(df).selectExpr("doc_id", "licenses.paragraphs.label AS labels").collect()}
    assert all(label in got[k] for k, (_, label) in enumerate(L.PARAGRAPHS))
    assert {"mit", "bsd", "bsd-3", "isc", "apache-2", "gpl-2", "gpl-3", "lgpl-2.1", "agpl-3", "mpl-2", "cc0"} <= {
        label for _, label in L.PARAGRAPHS}
    warranty = [t for t, label in L.PARAGRAPHS if label == "mit" and t.startswith("the software is provided as is")]
    assert len(warranty) == 1


@pytest.mark.parametrize("percent", [100, 90, 70])
def test_all_starts_equal_brute_force(percent):
    rng = random.Random(percent)
    templates = L.TEMPLATES + tuple(rng.sample(L.PARAGRAPHS, 20))
    vocabulary = " ".join(t for t, _ in templates).split()
    docs = [None, "", "all rights reserved"]
    for _ in range(25):
        words = []
        for _ in range(rng.randint(0, 4)):
            for x in rng.choice(templates)[0].split():
                words += [x] * (rng.random() < 0.95) + [rng.choice(vocabulary)] * (rng.random() < 0.3)
        docs.append(" ".join(words))
    got = found(L.Join(templates, L.PHRASES, {}, percent).rows(pa.array(docs)))
    assert got == [expected(t, templates, percent) for t in docs]
    assert sum(map(len, got)) > 100
