"""Operator 9: URL filter by fixed rules and mined association rules, native only.

Fixed rules name a host and the start of a path; a rule fits its host and all
subdomains, and the longest one that fits decides.

The method judges the other URLs.  URLs that a fixed rule decides are the labelled
transactions: all their distinct tokens (host labels, path segments, query keys) and
the verdict.  Tokens in less than ``MIN_SUPPORT`` of the transactions stand in no
frequent set and go before mining; tokens that stand in the same transactions are one
*class* (``classes``), as sets that differ only within a class have equal counts.
Spark's FP-growth mines the frequent sets of classes; association rules with a
verdict as consequent are kept if they reach ``MIN_CONFIDENCE`` and ``MIN_SUPPORT``
and no rule of a subset of their tokens is as confident.  Each kept rule is
indexed under its rarest class; the distinct URLs' classes are joined with that index
and the rest of the rule's classes verified.  The most confident rule wins (block
among equals); without any the verdict is allow.

The number of frequent tokens does not grow with the table: each stands in a share of
at least ``MIN_SUPPORT`` of the transactions, so there are at most 1 / ``MIN_SUPPORT``
times the tokens of a mean transaction.  No token is lost by its place in the URL.

Defined results: a null url, or one without ``://``, has empty host and path and no
tokens, so it is allowed; repeated rows get equal rows; without labelled URLs no
rule is mined; an empty table gives no rows; output columns replace the input's, all
other columns are kept, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_empty, written

MIN_SUPPORT, MIN_CONFIDENCE = 0.02, 0.8

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def fixed(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: ``h:`` host labels, ``p:`` path segments, ``q:`` query keys."""
    filled = lambda a: F.filter(a, lambda x: x != "")
    mark = lambda m, a: F.transform(a, lambda x: F.concat(F.lit(m), x))
    query = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(
        mark("h:", F.reverse(filled(F.split(host, r"\.")))),
        mark("p:", filled(F.split(path, "/"))), mark("q:", filled(keys))))


def classes(labelled: DataFrame, support: float = MIN_SUPPORT) -> DataFrame:
    """(token, class) of the frequent tokens of rows of (id, tokens, verdict).  ``class`` is the
    smallest token that stands in the same rows, told by two sums of the rows' hashes."""
    one = labelled.select("id", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("freq"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("x"),
        F.sum(F.xxhash64(F.lit("y"), "id").cast("decimal(38,0)")).alias("y"))
    total = labelled.agg(F.count("*").alias("total"))
    one = one.crossJoin(F.broadcast(total)).where(F.col("freq") >= F.lit(support) * F.col("total"))
    one = written(one.select("token", "freq", "x", "y"), "url-tokens")
    first = one.groupBy("freq", "x", "y").agg(F.min("token").alias("class"))
    return written(one.join(first, ["freq", "x", "y"]).select("token", "class"), "url-classes")


def _classed(rows: DataFrame, names: DataFrame, *by: str) -> DataFrame:
    """Rows of ``by`` (a key) with the classes of their ``tokens`` as ``items``."""
    each = rows.select(*by, F.explode_outer("tokens").alias("token"))
    # at most mean tokens / MIN_SUPPORT names
    return each.join(F.broadcast(names), "token", "left").groupBy(*by).agg(F.collect_set("class").alias("items"))


def mine(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(antecedent, verdict, confidence, support, key) from rows of (items, verdict)."""
    spark = labelled.sparkSession
    schema = "antecedent array<string>, verdict string, confidence double, support double, key string"
    baskets = labelled.select(F.concat("items", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    if is_empty(baskets):
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    rules = model.associationRules.where(F.element_at("consequent", 1).isin("=allow", "=block"))
    rules = rules.where(~F.exists("antecedent", lambda x: x.startswith("=")))
    rules = written(rules.select(F.array_sort("antecedent").alias("antecedent"),
                                 F.substr(F.element_at("consequent", 1), F.lit(2)).alias("verdict"),
                                 "confidence", "support"), "url-rules")
    # a rule goes if a part of its tokens says the same with at least its confidence
    part = rules.select("verdict", F.col("antecedent").alias("less"), F.col("confidence").alias("c"))
    held = rules.withColumn("lead", F.explode("antecedent")).alias("r").join(
        part.withColumn("lead", F.element_at("less", 1)).alias("p"), ["verdict", "lead"])
    held = held.where((F.size("less") < F.size("antecedent")) & (F.col("c") >= F.col("confidence"))
                      & (F.size(F.array_except("less", "antecedent")) == 0))
    rules = rules.join(held.select("antecedent", "verdict").distinct(), ["antecedent", "verdict"], "left_anti")
    tokens_ = rules.select("*", F.explode("antecedent").alias("token")).join(single, "token")
    rarest = tokens_.groupBy("antecedent", "verdict", "confidence", "support").agg(
        F.min(F.struct("freq", "token")).alias("m"))
    return written(rarest.select("antecedent", "verdict", "confidence", "support", F.col("m.token").alias("key")),
                   "url-index")


def judge(df: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Add host, path, rule, verdict and ``confidence`` (of the mined rule, else null)."""
    # the input's columns travel as one struct, so none can clash with those made here
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{url}`").cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("fixed", fixed(F.col("host"), F.col("path"), rules))
    seen = rows.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    labelled = written(seen.where("fixed is not null").select(
        F.monotonically_increasing_id().alias("id"), "tokens", F.col("fixed.verdict").alias("verdict")), "url-labelled")
    names = classes(labelled)
    index = mine(_classed(labelled, names, "id", "verdict"))
    is_open = F.col("fixed").isNull() & F.col("url").isNotNull()
    open_ = _classed(seen.where(is_open).select("url", "tokens").distinct(), names, "url")
    hits = open_.withColumn("key", F.explode("items")).join(index, "key")
    hits = hits.where(F.size(F.array_except("antecedent", "items")) == 0)
    # written first: a join with a table that is read can split a hot URL
    best = written(hits.groupBy("url").agg(F.max(F.struct("confidence", "verdict")).alias("best")), "url-best")
    out = rows.where(is_open).join(best, "url", "left")
    none = F.lit(None).cast("struct<confidence:double,verdict:string>")
    out = out.unionByName(rows.where(~is_open).withColumn("best", none))
    made = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("fixed.rule"),
            "verdict": F.coalesce("fixed.verdict", "best.verdict", F.lit("allow")), "confidence": F.col("best.confidence")}
    kept = [F.col("row")[c].alias(c) for c in df.columns if c.lower() not in made]
    return out.select(*kept, *[c.alias(name) for name, c in made.items()])
