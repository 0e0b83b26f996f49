import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from orderscope.llm import phrases as P
from orderscope.llm.queries import ORACLES, QUERIES

from .brute import FOLD
from .oracle import same

SF = "/root/testdata/sf0.01"


def pieces(rows):
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            yield "und" if lang is None else lang, re.findall(r"[^\x20\x09]+", piece)


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for lang, w in pieces(rows):
        n[lang] += len(w)
        for k in range(1, 5):
            f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    longest = Counter()
    for (lang, w), c in f.items():
        if c >= least and len(w) > 2:
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    key = lang, w[i:i + m]
                    longest[key] = max(longest[key], c)
    by = {}
    for (lang, w), a in f.items():
        if a >= least and len(w) > 1 and 100 * longest[lang, w] < 80 * a:
            cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            by.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in by.items()
                  for i, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


def ours(df, top=2000):
    return sorted(tuple(r) for r in P.collocations(df, top=top).collect())


def test_the_query_equals_its_sql(spark):
    assert same(spark, QUERIES["op13_collocations"], ORACLES["op13_collocations"], SF)


def rows_of(seed, n=1500):
    rng = np.random.default_rng(seed)
    words = ["the", "of", "a", "New", "york", "city", "é", "-", "x1", "#"]
    marks = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", "! "]
    text = lambda: "".join(words[a] + marks[b] for a, b in zip(rng.zipf(1.4, 25) % 10, rng.integers(0, 9, 25), strict=True))
    return [(text(), [None, "en", "en", "fr"][i % 4]) for i in range(n)]


def test_against_brute_force_with_many_routed_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "ROUTED", 50)
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    want = brute(rows, 30, 2000)
    assert len(want) > 40 and any(len(r[2].split()) == 4 for r in want)
    assert ours(df) == want
    assert ours(df, 7) == brute(rows, 30, 7)


def test_crowded_bitmaps_change_nothing(spark, monkeypatch):
    rows = rows_of(2, 300)
    df = spark.createDataFrame(rows, "text string, lang string")
    want = brute(rows, 30, 2000)
    monkeypatch.setattr(P, "_in", lambda bitmap, keys: np.ones(len(keys), bool))  # every rare word and pair passes
    assert ours(df) == want


def test_three_way_quicksort_counts_equal_partitions():
    rng = np.random.default_rng(3)
    cols = [rng.integers(1, 4, 500) for _ in range(4)]
    cut = rng.integers(1, 5, 500)
    cols = [np.where(cut > k, c, 0) for k, c in enumerate(cols)]
    weight = rng.integers(1, 5, 500)
    want = Counter()
    for i in range(500):
        for d in range(1, cut[i] + 1):
            want[tuple(int(c[i]) for c in cols[:d])] += int(weight[i])
    for least in (1, 20, 10**6):
        got = {tuple(int(c[row]) for c in cols[:d]): n for d, row, n in P.equal_partitions(cols, weight, least)}
        assert got == {k: n for k, n in want.items() if n >= least}


def test_nulls_ties_repeats_long_texts_empty_tables_and_other_columns(spark):
    many = [("A b, c\td. a b", "en")] * 30 + [("a b", None)] * 29 + [("p q", "und"), (None, "en"), ("", None), (" \n.,", "en")]
    rows = many + [("Same words " * 40_000, "fr"), ("tie one. tie two. " * 30, "de")]
    df = spark.createDataFrame(rows, "text string, lang string")
    want = brute(rows, 30, 2000)
    assert ours(df) == want and {r[0] for r in want} == {"en", "fr", "de"}
    clash = df.selectExpr("*", "1 as w", "2 as h", "3 as n", "4 as a", "5 as rank", "6 as key", "7 as word")
    assert ours(clash) == want
    assert ours(df.limit(0)) == [] and ours(df.where("lang is null")) == []


def test_tasks_hold_bounded_arrays_whatever_the_text():
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(5000)])
    text = " ".join(words[rng.zipf(1.3, 10_000) % 5000])
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 32), pa.array(["en"] * 32)], ["text", "lang"])
    every = SimpleNamespace(value=b"\xff" * (P.BITS // 8))
    for stage in (P._words, P._pairs(every), P._suffixes(every, every)):
        tracemalloc.start()
        rows = sum(b.num_rows for b in stage(iter([batch] * 12)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows and peak < 260 << 20, (stage, peak >> 20)
