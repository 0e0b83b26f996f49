import re
from collections import Counter
from itertools import combinations

from orderscope.llm import url_rules as U
from orderscope.llm.queries import QUERIES

from ..conftest import SF_SMALL

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(url):
    if not url or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host, path, query = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", rest).groups()
    return host.translate(FOLD), path, query or ""


def ruled(host, path):
    fits = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=None)


def token_set(url):
    host, path, query = split(url)
    labels = [x for x in host.split(".") if x][::-1]
    parts = [x for x in path.split("/") if x]
    keys = [x.split("=")[0] for x in query.split("&")]
    return {f"h:{x}" for x in labels} | {f"p:{x}" for x in parts} | {f"q:{x}" for x in [k for k in keys if k]}


def expected(urls):
    """Verdicts by counting every token set of the labelled URLs."""
    labelled = [(token_set(u), ruled(*split(u)[:2])[1]) for u in urls if ruled(*split(u)[:2])]
    count, both, least = Counter(), Counter(), U.MIN_SUPPORT * len(labelled)
    one = Counter(t for ts, _ in labelled for t in ts)
    for ts, v in labelled:
        some = sorted(t for t in ts if one[t] >= least)
        for n in range(1, len(some) + 1):
            for s in combinations(some, n):
                count[s] += 1
                both[s, v] += 1
    rules = [(set(s), v, n / count[s]) for (s, v), n in both.items()
             if n >= least and n / count[s] >= U.MIN_CONFIDENCE]
    out = []
    for u in urls:
        if (r := ruled(*split(u)[:2])):
            out.append(r)
        else:
            ts = token_set(u)
            best = max(((c, v) for s, v, c in rules if s <= ts), default=(0, "allow"))
            out.append((None, best[1]))
    return out


def test_query_on_all_pages(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op9_url_rules"](spark, SF_SMALL).collect()}
    want = dict(zip(urls, expected(list(urls.values())), strict=True))
    assert len(got) == len(urls)
    for k, u in urls.items():
        assert (got[k].host, got[k].path) == split(u)[:2]
        assert (got[k].rule, got[k].verdict) == want[k], u


def test_odd_urls_ties_and_clashing_columns(spark):
    urls = [None, "", "no scheme", "x://", "http://A.ORG", "http://org/", "http://EXAMPLE.org/es/1?x=/en/1#y", "http://xexample.org/es/",
            "http://a.example.org/en/12", "http://b.com/fr/?a&b", "http://com/de/", "http://É.com?q://z/de/", "a://b://c/de/",
            "http://q.net/de/x", "http://q.net/de/x", "http://..org//es"]
    df = spark.createDataFrame([(i, u, "v", "h") for i, u in enumerate(urls)], "page_id long, url string, verdict string, host string")
    got = [(r.rule, r.verdict) for r in sorted(U.judge(df).collect())]
    assert got == expected(urls)
    assert U.judge(df.limit(0)).count() == 0


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "http://q.net/de/x")], "page_id long, url string")
    plan = U.judge(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_with_any_names_are_kept(spark):
    names = ["_url", "_best", "_fixed", "tokens", "fixed", "best", "row", "key", "items"]
    rows = [(1, "http://a.org/x"), (2, None), (3, "http://b.net/de/y?z=1"), (3, "http://b.net/de/y?z=1"), (4, "no url")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", *[f"page_id + {i} as {c}" for i, c in enumerate(names)], "'old' as verdict")
    out = U.judge(df).collect()
    assert len(out) == 5 and all([r[c] for c in names] == [r.page_id + i for i in range(len(names))] for r in out)
    assert {r.verdict for r in out} == {"allow"} and {r.url for r in out} == {x for _, x in rows}
