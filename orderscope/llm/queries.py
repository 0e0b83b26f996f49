"""Queries of this package: ``opN_<name>(spark, sf_dir)`` and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, chat, decontaminate, divergence, licenses, line_rules, near_dedup, phrases, quality, toxicity,
               url_rules, warc, wavelet)
from .common import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    df = byte_bpe.decode(df, path, public_tokenizers.PATTERN)
    return df.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


_OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3),
        lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
u AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS k FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
      FROM u a JOIN u b ON a.k = b.k AND a.r <> b.r GROUP BY a.r, b.r, 1, 2, 3, 4),
l AS (SELECT DISTINCT x, y FROM p WHERE 100 * c >= 75 * (nx + ny - c) AND x <> y),
reach AS (SELECT DISTINCT doc_id AS x, doc_id AS m FROM s UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.m = l.x),
g AS (SELECT x, min(m) AS m FROM reach GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, g.m AS component_id, s.doc_id = g.m AS kept
FROM s JOIN g ON s.doc_id = g.x"""


@query("op10_near_dedup", _OP10_SQL)
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_wavelet_tokens")
def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = wavelet.write(table(spark, sf_dir, "documents"), path, end_id=2)
    return wavelet.read(manifest).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT coalesce(item_id::VARCHAR, '') AS item, least(13, len(w)) AS s, w
       FROM (SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
       WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, s, array_to_string(w[i:i + s - 1], ' ') AS k
       FROM (SELECT item, s, w, unnest(range(1, len(w) - s + 2)) AS i FROM it)),
dw AS (SELECT r, s, i, array_to_string(w[i:i + s - 1], ' ') AS k
       FROM (SELECT r, s, w, unnest(range(1, len(w) - s + 2)) AS i
             FROM d, (SELECT DISTINCT s FROM iw) WHERE len(w) >= s)),
h AS (SELECT DISTINCT dw.r, dw.i, dw.s, iw.item FROM dw JOIN iw ON dw.k = iw.k AND dw.s = iw.s),
c AS (SELECT r, count(DISTINCT i + o) AS n FROM (SELECT r, i, unnest(range(0, s)) AS o FROM h) GROUP BY r),
g AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(g.n, 0)::BIGINT AS n_items,
  sha256(coalesce(g.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN g USING (r)"""


@query("op6_decontaminate", _OP6_SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "hits.n_words", decontaminate.covered().alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"))


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("licenses.places.label")
    blocks = F.concat("licenses.blocks", "licenses.paragraphs")
    return found.select(
        "doc_id", "licenses.n_words", F.size("licenses.places").cast("long").alias("n_base"),
        F.array_min("licenses.places.word").alias("first_word"), F.array_max("licenses.places.word").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, blocks["label"])), ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(
            F.coalesce(F.array_max(blocks["containment"]), F.lit(0.0))).alias("score"))


@query("op2_pu_quality")
def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score",
                         (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


_BOILERPLATE = " OR ".join(f"contains(lower(x), '{p}')" for p in (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript",
    "click here", "subscribe to our", "sign up for", "powered by", "lorem ipsum", "skip to content", "back to top"))

_OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             string_split(t, chr(10)) AS l FROM d),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM win, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY r),
c AS (SELECT w.*, coalesce(rep.n, 0) AS n_repeat_words,
  list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines,
  list_filter(l, lambda x: NOT (length(x) > 0 AND (
    (length(regexp_replace(x, '[^|»›•]+', '', 'g')) >= 3 AND 200 * length(regexp_replace(x, '[^|»›•]+', '', 'g')) >= length(x))
    OR 10 * length(regexp_replace(x, '[^#*$%&|<>{{}}~^=_+\\]+', '', 'g')) > length(x)
    OR (len(regexp_extract_all(x, '[!?]{{2,}}')) >= 3 AND 200 * len(regexp_extract_all(x, '[!?]{{2,}}')) >= length(x))
    OR (NOT regexp_matches(x, '[.,;:!?…。，！？]') AND
        regexp_matches(x, '^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{9}}[^\x20\x09-\x0D]'))
    OR (length(x) <= 400 AND ({_BOILERPLATE}))))) AS lines_left
  FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, len(w) < 50 OR 100 * n_repeat_words > 50 * len(w) AS base_failed FROM c)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * length(array_to_string(lines_left, '')) >= 50 * length(array_to_string(l, '')) AS kept
FROM b"""


@query("op4_line_rules", _OP4_SQL)
def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "rules.n_words", "rules.word_chars", "rules.n_symbols", "rules.n_dup_lines",
                        "rules.n_repeat_words", "rules.base_failed", "rules.kept")


_OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(url_encode(role)) + 1 + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END
        + length(regexp_replace(text, '(<|\[)(\\*)(/?s>|/?INST\]|\|)', '\1\\\2\3', 'g')) AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@query("op3_chat_format", _OP3_SQL)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control.alias("text"))
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    talks = talks.withColumn("parts", chat.text_parts(F.col("text")))
    back = chat.read_back(written(chat.format_conversations(talks), "chat"))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    under = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length(under).cast("long").alias("loss_chars"), F.sha2(under, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op9_url_rules")
def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages).select("page_id", "host", "path", "rule", "verdict")


_OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM m"""


@query("op7_warc", _OP7_SQL)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = warc.write(warc.deduplicated(table(spark, sf_dir, "pages")))
    back = warc.read(*warc.normalise(raw))
    # of a response the bytes that were read count, of a revisit what its header says of the full payload
    own = F.col("record_type") == "response"
    return back.select(
        "page_id", F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to")


_OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_FOLD} AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS k FROM d),
kept AS (SELECT lang, k, count(*) AS total FROM w GROUP BY lang, k HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM kept GROUP BY lang),
c AS (SELECT lang, source, k, count(*) AS n FROM w SEMI JOIN kept USING (lang, k) GROUP BY lang, source, k),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT lang, source, k, coalesce(c.n, 0) AS own, total, nl, v,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.n + v) AS p, 1 + (1000000000::HUGEINT * (total + 1)) // (nl + v) AS q
      FROM s JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, k)),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                  FROM p a JOIN p b ON a.lang = b.lang AND a.k = b.k AND a.source <> b.source GROUP BY 1, 2, 3) x
       ON a.lang = x.lang AND a.source = x.source AND b.source = x.item),
t AS (SELECT lang, source, 'term' AS part, k AS item, (p - q) * (p - q) // q AS value FROM p WHERE own > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM pr UNION ALL SELECT * FROM t))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200"""


@query("op11_divergence", _OP11_SQL)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= toxicity.LIMIT).cast("int").alias("predicted"))


_OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_FOLD}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
f AS (SELECT lang, w[i:i + k - 1] AS g, count(*) AS c
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
      GROUP BY 1, 2 HAVING count(*) >= 30),
cut AS (SELECT x.lang, x.g, x.c AS a, k, y.c AS l, z.c AS r, (2000000::HUGEINT * x.c) // (y.c + z.c) AS score
        FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1) x
        JOIN f y ON x.lang = y.lang AND x.g[1:k] = y.g JOIN f z ON x.lang = z.lang AND x.g[k + 1:len(x.g)] = z.g),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
sub AS (SELECT lang, g[i:i + m - 1] AS g, max(c) AS longer
        FROM (SELECT lang, g, c, m, unnest(range(1, len(g) - m + 2)) AS i
              FROM (SELECT *, unnest(range(2, len(g))) AS m FROM f WHERE len(g) > 2)) GROUP BY 1, 2),
r AS (SELECT best.*, array_to_string(best.g, ' ') AS phrase FROM best LEFT JOIN sub USING (lang, g)
      WHERE longer IS NULL OR 100 * longer < 80 * a),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM r)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n::BIGINT AS n, score::BIGINT AS score
FROM k JOIN n USING (lang) WHERE rank <= 2000"""


@query("op13_collocations", _OP13_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
