import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from orderscope.llm import divergence as V
from orderscope.llm.queries import ORACLES, QUERIES

from .brute import FOLD
from .oracle import same

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string"


def brute(rows, top=200):
    count, docs, groups, total = Counter(), Counter(), set(), Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        docs.update({(lang, k) for k in found})
        count.update((lang, source, k) for k in found)
    kept = defaultdict(list)
    for (lang, k), n in docs.items():
        if n >= 3:
            kept[lang].append(k)
    for (lang, _, k), n in count.items():
        total[lang, k] += n
    out = []
    for lang, source in groups:
        terms = kept[lang]
        n = {s: sum(count[lang, s, k] for k in terms) for g, s in groups if g == lang}
        p = lambda s, k: 1 + 10**9 * (count[lang, s, k] + 1) // (n[s] + len(terms))  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // b
        pairs = [(s, sum(f(p(source, k), p(s, k)) for k in terms)) for s in n if s != source]
        whole = sum(n.values())
        own = []
        for k in terms:
            q = 1 + 10**9 * (total[lang, k] + 1) // (whole + len(terms))
            if count[lang, source, k] and p(source, k) > q:
                own.append((k, f(p(source, k), q)))
        for part, items, most in (("pair", pairs, None), ("term", own, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


def ours(df, **kw):
    return sorted(tuple(r) for r in V.divergence(df, **kw).collect())


def test_the_query_equals_its_sql(spark):
    assert same(spark, QUERIES["op11_divergence"], ORACLES["op11_divergence"], SF)


def test_levels_blocks_and_frequent_terms_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 3)  # several blocks of sources
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(words[k] for k in rng.zipf(1.3, 60) % 300), "en" if i % 4 else "xx", f"s{i % 8}") for i in range(160)]
    df = spark.createDataFrame(rows, KIND)
    assert ours(df, top=5) == brute([r[1:] for r in rows], 5)


def test_nulls_ties_repeats_hot_source_empty_table_and_other_columns(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (3, "Ä ä ß", "en", None), (4, "b A! c", "en", "z"),
            (4, "b A! c", "en", "z"), (5, "a b C", "en", "a"), (6, "x", "fr", "a"), (7, "y", "fr", "b"), (8, "ä_ä", "en", "y"),
            (9, "c " * 70 + "b", "en", "z"), (None, "c1c", "en", "a")]
    df = spark.createDataFrame(rows, KIND)
    want = brute([r[1:] for r in rows])
    assert ours(df) == want
    clash = df.selectExpr("*", "1 as n", "2 as own", "3 as term", "4 as place", "5 as rank", "6 as value", "7 as bits")
    assert ours(clash) == want
    assert V.divergence(df.limit(0)).collect() == []


def test_one_joint_cell_by_hand():
    t = pa.table({"lang": ["en"] * 3, "chunk": [0] * 3, "place": pa.array([0, 1, 1], pa.int32()), "block": [0] * 3, "n": [2, 1, 5],
                  "word": pa.array([0] * 3, pa.int32()), "bits": [0b111, 0b011, 0b100], "p": [30, 20, 60], "p0": [10, 5, 5]})
    out = V._joint(tuple(pa.scalar(x) for x in ("en", 0, 0, 0)), t).to_pylist()
    f = lambda p, q: (p - q) ** 2 // q
    d = lambda p, q, p0, q0: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    got = {(r["a"], r["b"]): (r["high"] << 32) + r["low"] for r in out}
    assert got == {(0, 1): 2 * d(30, 20, 10, 5) + d(30, 60, 10, 5), (1, 0): 2 * d(20, 30, 5, 10) + d(60, 30, 5, 10)}


def test_shares_of_huge_counts_do_not_overflow(spark):
    row = spark.range(1).selectExpr("cast(900000000000 as long) n", "cast(1000000000000 as long) mine", "cast(5 as long) kept")
    assert row.select(V.share("n", "mine").alias("p")).first()["p"] == 1 + 10**9 * 900000000001 // 1000000000005
