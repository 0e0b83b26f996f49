"""Operator 11: how far the sources of each language differ in their terms.

Terms are runs of letters and non-ASCII characters (A-Z in lower case).  A language
keeps its terms that stand in at least ``MIN_DOCS`` of its rows.  A group is a
(lang, source) that occurs; with V kept terms and N their occurrences in the group, a
term of count c has p = 1 + floor(SCALE * (c + 1) / (N + V)), and

    f(p, q) = floor((p - q)^2 / q).

Part ``pair``: f summed over all kept terms, of a group against every other source of
its language.  Part ``term``: f of the group's own terms that are more frequent in it
than in its language, the ``TOP`` greatest.

Count-level bitmaps.  Kept terms get ids, and every (group, count) gets the bitset of
the ids that have this count there, in 64-bit words.  Of two groups, AND and popcount
of their bitsets give the number of terms in each joint cell (count here, count
there), which is multiplied by f of the cell.  Count 0 has no bitset: its cells follow
by complement.  With 0 standing for absence,

    sum = V f(0, 0) + sum_c |A_c| (f(c, 0) - f(0, 0)) + sum_d |B_d| (f(0, d) - f(0, 0))
        + sum_{c, d} |A_c & B_d| (f(c, d) - f(c, 0) - f(0, d) + f(0, 0)),

so the bitsets are only compared where both groups have them.

Work is keyed by (lang, chunk of ids, two blocks of ``BLOCK`` sources).  A chunk has 64
terms where the terms are frequent (they may have 64 counts each) and 1,024 where
their total is below 64, so a task holds at most ``2 * BLOCK * 1024`` bits at once,
however many rows one source has; tasks count words before the first shuffle.  The
only broadcast is the table of groups, where it has at most 100,000 rows.

Integers only: p, q and f fit 64 bits, sums are kept in two halves and added as
decimals.  Defined results: null text, lang and source are '', a text without terms
counts as a row of its group; repeated rows count as often as they stand; a language
without kept terms has V = 0, value 0 against every other source and no terms; a
language with one source has no pairs; an empty table gives no rows.  Ties go to the
smaller item in UTF-8 order.  Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lookups import lookup_join
from . import tally, textvec
from .common import tune, written

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Sources compared in one block; terms of a chunk, by whether they are frequent.
BLOCK = 64
FREQUENT, CHUNK = 64, {True: 64, False: 1024}

#: Letters and all non-ASCII bytes: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``.
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang, source) to (lang, source, term, n, docs)."""
    for b in tally.gathered(batches):
        w = textvec.words(b.column(0), LETTERS)
        if not len(w.hash):
            continue
        terms, term = np.unique(w.hash, return_inverse=True)
        last = np.empty(len(terms), np.int64)
        last[term] = np.arange(len(term))
        names = tally.strings(w.buf, w.start[last], w.end[last])
        pair = pa.StructArray.from_arrays([b.column(1), b.column(2)], ["lang", "source"])
        index: dict = {}
        group = np.array([index.setdefault((p["lang"], p["source"]), len(index)) for p in pair.to_pylist()], np.int64)
        seen, n = tally.summed(w.texts() * len(terms) + term)  # each (text, term) once
        code = group[seen // len(terms)] * len(terms) + seen % len(terms)
        code, n, docs = tally.summed(code, n, np.ones_like(n))
        of = code // len(terms)
        lang, source = (pa.array([k[j] for k in index]) for j in (0, 1))
        out = [lang.take(pa.array(of)), source.take(pa.array(of)), names.take(pa.array(code % len(terms))).cast(pa.string()),
               pa.array(n), pa.array(docs)]
        yield pa.RecordBatch.from_arrays(out, ["lang", "source", "term", "n", "docs"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in order of (lang, term): each term gets the next id among the partition's
    frequent or other terms, as (chunk, word, bit); ``lead`` marks its first row."""
    part = TaskContext.get().partitionId()
    before, count, now = None, {True: 0, False: 0}, None
    for b in batches:
        lead, chunk, word, bit = [], [], [], []
        for key, total in zip(zip(b["lang"].to_pylist(), b["term"].to_pylist(), strict=True), b["total"].to_pylist(), strict=True):
            lead.append(key != before)
            if key != before:
                frequent, before = total >= FREQUENT, key
                k, inside = divmod(count[frequent], CHUNK[frequent])
                count[frequent] += 1
                now = ((part * 2 + frequent << 36) + k, inside // 64, inside % 64)
            chunk.append(now[0])
            word.append(now[1])
            bit.append(now[2])
        cols = [pa.array(lead, pa.bool_()), pa.array(chunk, pa.int64()), pa.array(word, pa.int32()), pa.array(bit, pa.int32())]
        yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "lead", "chunk", "word", "bit"])


def cells(df: DataFrame) -> DataFrame:
    """(lang, source, term, n, total, lead, chunk, word, bit) of the kept terms, from
    (text, lang, source); one shuffle, by language and term."""
    counted = df.select("text", "lang", "source").mapInArrow(
        _counted, "lang string, source string, term string, n long, docs long")
    by = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # at most a row for each source
    by = by.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("df"), F.sum("n").over(term).alias("total"))
    by = by.where(F.col("df") >= MIN_DOCS).drop("df").sortWithinPartitions("lang", "term")
    kind = "lang string, source string, term string, n long, total long, lead boolean, chunk long, word int, bit int"
    return by.mapInArrow(_numbered, kind)


def _groups(df: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each group: N, V, the language's N, and the source's place and block in its language."""
    n = found.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count_if("lead").alias("leads"))
    g = df.select("lang", "source").distinct().join(n, ["lang", "source"], "left")
    lang = Window.partitionBy("lang")  # groups only
    place = F.row_number().over(lang.orderBy("source")) - 1
    zero = F.lit(0).cast("long")
    return g.select("lang", "source", F.coalesce("own", zero).alias("mine"), F.coalesce(F.sum("leads").over(lang), zero).alias("kept"),
                    F.coalesce(F.sum("own").over(lang), zero).alias("whole"), place.alias("place"),
                    F.floor(place / BLOCK).cast("int").alias("block"))


def share(count: str, total: str, terms: str = "kept") -> Column:
    """p of a count; NULL where no term is kept."""
    top = f"cast({SCALE} as decimal(10,0)) * (cast({count} as decimal(18,0)) + 1)"
    return F.expr(f"1 + ({top}) div nullif(cast({total} + {terms} as decimal(19,0)), 0)")


def excess(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _joint(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
    """Sums over the joint cells of one chunk, for both directions of each pair of sources
    whose blocks are the key's: in halves of 32 bits, which no sum here can overflow."""
    lang, _, first, second = (k.as_py() for k in key)
    place, n, word, p, p0, block = (batch[c].to_numpy() for c in ("place", "n", "word", "p", "p0", "block"))
    order = np.lexsort((n, place))
    new = np.append(True, (np.diff(place[order]) != 0) | (np.diff(n[order]) != 0))
    level = np.empty(len(n), np.int64)
    level[order] = np.cumsum(new) - 1
    head = order[new]
    place, p, p0, block = place[head], p[head], p0[head], block[head]
    words = np.zeros((int(word.max()) + 1, len(head)), np.uint64)
    words[word, level] = batch["bits"].to_numpy().view(np.uint64)
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    codes, sums = [], []
    step = max(1, 2_000_000 // max(1, len(right)))
    for lo in range(0, len(left), step):
        a = left[lo:lo + step]
        joint = np.zeros((len(a), len(right)), np.int64)
        for w in words:
            joint += np.bitwise_count(w[a][:, None] & w[right][None, :])
        i, j = np.nonzero(joint)
        size, i, j = joint[i, j], a[i], right[j]
        ahead = place[i] < place[j]  # within one block every pair comes up twice
        size, i, j = size[ahead], i[ahead], j[ahead]
        for x, y in ((i, j), (j, i)):
            d = _f(p[x], p[y]) - _f(p[x], p0[y]) - _f(p0[x], p[y]) + _f(p0[x], p0[y])
            codes.append(place[x].astype(np.int64) << 32 | place[y])
            sums.append(np.stack([(d >> 32) * size, (d & 0xFFFFFFFF) * size]))
    code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    high, low = np.concatenate(sums, 1) if sums else np.zeros((2, 0), np.int64)
    code, high, low = tally.summed(code, high, low)
    return pa.table({"lang": pa.array([lang] * len(code), pa.string()), "a": (code >> 32).astype(np.int32),
                     "b": (code & 0xFFFFFFFF).astype(np.int32), "high": high, "low": low})


def divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups."""
    spark = df.sparkSession
    tune(spark)
    df = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
                     for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    found = written(cells(df), "cells")
    groups = written(_groups(df, found), "groups")
    size, most = groups.agg(F.count("*"), F.coalesce(F.max("block"), F.lit(0))).first()

    bits = F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")
    bitmaps = written(found.groupBy("lang", "chunk", "source", "n", "word").agg(bits), "bitmaps")
    rows = lookup_join(bitmaps, groups, ["lang", "source"], size=size)
    rows = rows.select("lang", "chunk", "place", "block", "n", "word", "bits", share("n", "mine").alias("p"),
                       share("0", "mine").alias("p0"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("other"))
    rows = rows.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    joint = rows.groupBy("lang", "chunk", "first", "second").applyInArrow(
        _joint, "lang string, a int, b int, high long, low long")
    wide = "decimal(38,0)"
    joint = joint.select("lang", "a", "b", (F.col("high").cast(wide) * 4294967296 + F.col("low")).cast(wide).alias("v"))

    levels = bitmaps.groupBy("lang", "source", "n").agg(F.sum(F.bit_count("bits")).alias("terms"))
    levels = lookup_join(levels, groups, ["lang", "source"], size=size).select(
        "lang", F.col("place").alias("x"), "terms", share("n", "mine").alias("px"), share("0", "mine").alias("x0"))
    others = groups.select("lang", F.col("place").alias("y"), share("0", "mine").alias("y0"), "kept")
    alone = lookup_join(levels, others, ["lang"], size=size).where("x != y")
    ahead = alone.select("lang", F.col("x").alias("a"), F.col("y").alias("b"),
                         (F.col("terms") * (excess("px", "y0") - excess("x0", "y0")).cast(wide)).cast(wide).alias("v"))
    back = alone.select("lang", F.col("y").alias("a"), F.col("x").alias("b"),
                        (F.col("terms") * (excess("y0", "px") - excess("y0", "x0")).cast(wide)).cast(wide).alias("v"))
    mine = groups.select("lang", F.col("place").alias("x"), share("0", "mine").alias("x0"))
    base = lookup_join(mine, others, ["lang"], size=size).where("x != y").select(
        "lang", F.col("x").alias("a"), F.col("y").alias("b"),
        F.coalesce((F.col("kept") * excess("x0", "y0").cast(wide)).cast(wide), F.lit(0).cast(wide)).alias("v"))
    pairs = joint.unionByName(ahead).unionByName(back).unionByName(base).groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))
    pairs = lookup_join(pairs, groups.select("lang", F.col("place").alias("a"), "source"), ["lang", "a"], size=size)
    pairs = lookup_join(pairs, groups.select("lang", F.col("place").alias("b"), F.col("source").alias("item")), ["lang", "b"], size=size)

    terms = lookup_join(found, groups, ["lang", "source"], size=size).select(
        "lang", "source", F.col("term").alias("item"), share("n", "mine").alias("p"), share("total", "whole").alias("q"))
    terms = terms.where("p > q").select("lang", "source", "item", excess("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    # the limit on row_number is applied in every task before the rows of a group meet
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= top)
    pairs = pairs.select("lang", "source", "item", F.col("v").cast("long").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    return pairs.unionByName(terms)
