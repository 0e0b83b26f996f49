import pytest

from orderscope.llm import url_rules as U

from .test_url_rules import expected


def judged(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return [(r.rule, r.verdict) for r in sorted(U.judge(df).collect())]


@pytest.mark.parametrize("late", ["http://{h}/a/b/c/late", "http://late.k.l.m.{h}/x", "http://{h}/x?a=1&b=2&c=3&late=4"])
def test_deciding_token_at_any_place(spark, late):
    blocked = [late.replace("{h}", "example.org").replace("example.org/", "example.org/es/", 1) for _ in range(5)]
    allowed = [f"http://s{i}.org/a/b/c/{i}?a=1&b=2&c=3" for i in range(5)] + [f"http://k.l.m.w{i}.org/x?a=1&b=2&c=3" for i in range(5)]
    urls = blocked + allowed + [late.replace("{h}", "else.net"), "http://else.net/a/b/c/d?a=1&b=2&c=3"]
    got = judged(spark, urls)
    assert got[-2:] == [(None, "block"), (None, "allow")]


def test_equals_brute_force_on_long_urls(spark):
    urls = [f"http://a{i % 3}.b.c.d.e{i % 2}.example.org/{'es' if i % 4 else 'fr'}/p{i % 5}/q{i % 3}/r{i % 2}?{'k&' * (i % 3)}m{i % 2}=1&n&o"
            for i in range(24)]
    urls += [f"http://a{i % 3}.b.z.d.e{i % 2}.net/x/y/q{i % 3}/r{i % 2}/p{i % 5}?o&n&m{i % 2}" for i in range(12)]
    assert judged(spark, urls) == expected(urls)


def test_many_tokens_of_the_same_rows_are_one_class(spark):
    path = "/".join(f"s{i}" for i in range(60))
    urls = [f"http://example.org/es/{path}", "http://example.org/es/1", f"http://q.net/x/{path}", "http://q.net/x/s59", "http://a.org/y"]
    assert [v for _, v in judged(spark, urls)][2:] == ["block", "block", "allow"]
