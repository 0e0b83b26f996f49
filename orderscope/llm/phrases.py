"""Operator 13: collocations, counted by multikey three-way quicksort of suffix pointers.

Texts (A-Z in lower case) are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those
into words ``[^\\x20\\x09]+``.  Every word starts a suffix, cut to ``DEPTH`` words and at
the end of its piece.  Per language, f(phrase) is the number of suffixes that begin
with the phrase; candidates are phrases of 2 to ``DEPTH`` words with f >= ``LEAST``.

1. Words are counted; n is their number.  A suffix whose first or second word is
   rarer than ``LEAST`` is abandoned.
2. Pairs of adjacent words are counted by hash; a suffix is abandoned if its leading
   pair is rare, and cut before a rare pair.
3. The suffixes that are left are written, equal ones of a task as one with a count.
   Their leading pairs are summed; those of three and more words are routed over the
   cluster by language and three leading words, about ``ROUTED`` a task, and
   each task sorts pointers to them by multikey three-way quicksort to maximum depth:
   the size of an equal partition is f of its words, and a partition of fewer than
   ``LEAST`` suffixes is abandoned at once.  All suffixes of a phrase of three or more
   words are in one task, and no others are needed to count it.

Which words and pairs are frequent travels as bitmaps of fixed size (``BITS`` bits
each), which may let rare ones pass and never hold a frequent one back; counts
come from the words' own 64-bit hashes.  A hot word, pair or source is counted in
its tasks before it is shuffled, and a hot leading pair is split by its third words.

Score: cutting a candidate after k words gives l = f(first part), r = f(rest) and
floor(2000000 a / (l + r)); the lowest counts, ties to the smallest k.  Candidates are
dropped if their words stand in a longer candidate (dropped or not) with
100 f(longer) >= 80 a.  Arithmetic is in decimals.

Defined results: null texts are empty, null languages ``und`` (and one with languages
of that name); repeated rows count as often as they stand; an empty table, or one
without frequent phrases, gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lookups import lookup_join
from . import tally, textvec
from .common import tune, written

DEPTH = 4
LEAST = 30
TOP = 2_000
BITS = 1 << 26
#: Bytes of text that a task counts at once, about: its arrays take some 50 times as much.
GATHER = 4 << 20
#: Suffixes that one task sorts, about.
ROUTED = 500_000

BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~BREAKS
WORD[[0x20, 0x09]] = False


class Suffixes:
    """Words of a batch of (text, lang): ``hash``, language number and salt of each word,
    and ``last``: whether it ends its piece."""

    def __init__(self, b: pa.RecordBatch):
        self.words = w = textvec.words(b.column(0), WORD)
        code = b.column(1).dictionary_encode()
        self.langs = code.dictionary
        text = w.texts()
        self.lang = code.indices.to_numpy()[text]
        salt = [zlib.crc32(x.encode()) for x in self.langs.to_pylist()]
        self.salt = textvec.mix(np.array(salt, np.uint64))[self.lang]
        breaks = np.concatenate([[0], np.cumsum(BREAKS[w.buf])])
        self.last = np.ones(len(text), bool)
        self.last[:-1] = (text[1:] != text[:-1]) | (breaks[w.start[1:]] != breaks[w.end[:-1]])

    def word_keys(self) -> np.ndarray:
        return textvec.mix(self.words.hash ^ self.salt)

    def pair_keys(self) -> np.ndarray:
        """Key of each word with the next one (the last word's means nothing)."""
        h = self.words.hash
        return textvec.mix(np.append(textvec.shingles(h, 2), np.zeros(min(1, len(h)), np.uint64)) ^ self.salt)

    def pairs(self, frequent: np.ndarray) -> np.ndarray:
        """Whether each word and the next one are in one piece and both ``frequent``."""
        out = frequent & ~self.last
        out[:-1] &= frequent[1:]
        return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in tally.gathered(batches, size=GATHER):
        s = Suffixes(b)
        w, key = s.words, s.word_keys()
        if not len(key):
            continue
        keys, at = np.unique(key, return_inverse=True)
        one = np.empty(len(keys), np.int64)
        one[at] = np.arange(len(at))
        names = tally.strings(w.buf, w.start[one], w.end[one]).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [s.langs.take(pa.array(s.lang[one])), names, pa.array(w.hash[one].view(np.int64)), pa.array(keys.view(np.int64)),
             pa.array(np.bincount(at))], ["lang", "word", "h", "key", "n"])


def _in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(BITS - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _pairs(words):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = np.frombuffer(words.value, np.uint8)
        for b in tally.gathered(batches, size=GATHER):
            s = Suffixes(b)
            keys, n = tally.summed(s.pair_keys()[s.pairs(_in(frequent, s.word_keys()))])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])
    return count


def _suffixes(words, pairs):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, leading = np.frombuffer(words.value, np.uint8), np.frombuffer(pairs.value, np.uint8)
        for b in tally.gathered(batches, size=GATHER):
            s = Suffixes(b)
            h = s.words.hash
            more = s.pairs(_in(frequent, s.word_keys())) & _in(leading, s.pair_keys())
            at = np.flatnonzero(more)
            if not len(at):
                continue
            cols, goes_on = [h[at]], np.ones(len(at), bool)
            padded, further = np.append(h, np.zeros(DEPTH, np.uint64)), np.append(more, np.zeros(DEPTH, bool))
            for d in range(1, DEPTH):
                goes_on &= further[at + d - 1]
                cols.append(np.where(goes_on, padded[at + d], np.uint64(0)))
            lang = s.lang[at]
            order = np.lexsort((*cols[::-1], lang))
            cols, lang = [c[order] for c in cols], lang[order]
            new = np.append(True, np.any([x[1:] != x[:-1] for x in (*cols, lang)], axis=0))
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(new)))
            yield pa.RecordBatch.from_arrays(
                [s.langs.take(pa.array(lang[head])), *[pa.array(c[head].view(np.int64)) for c in cols], pa.array(n)],
                ["lang", *NAMES, "n"])
    return rows


NAMES = [f"w{k + 1}" for k in range(DEPTH)]


def equal_partitions(columns: list[np.ndarray], weight: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of pointers to the rows of ``columns`` (a column a key;
    0 ends a row): (depth, a row, total weight) of every partition that is equal in its
    first ``depth`` keys and weighs ``least`` or more.  Lighter partitions are abandoned."""
    stack = [(np.arange(len(weight)), 0)]
    while stack:
        rows, depth = stack.pop()
        if not len(rows) or weight[rows].sum() < least:
            continue
        key = columns[depth][rows]
        a, b, c = key[0], key[len(key) // 2], key[-1]
        pivot = max(min(a, b), min(max(a, b), c))  # median of three
        low, high = key < pivot, key > pivot
        stack += [(rows[low], depth), (rows[high], depth)]
        if pivot == 0:
            continue
        same = rows[~(low | high)]
        total = int(weight[same].sum())
        if total >= least:
            yield depth + 1, int(same[0]), total
            if depth + 1 < len(columns):
                stack.append((same, depth + 1))


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of three and more words with ``LEAST`` or more suffixes of a routed partition."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    lang = t["lang"].combine_chunks().dictionary_encode()
    columns = [lang.indices.to_numpy().astype(np.int64) + 1, *[t[c].to_numpy() for c in NAMES]]
    found = [x for x in equal_partitions(columns, t["n"].to_numpy(), LEAST) if x[0] > 3]  # the language is the first key
    depth, row, total = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    words = [pa.array(np.where(depth > k + 1, columns[k + 1][row], 0)) for k in range(DEPTH)]
    langs = lang.dictionary.take(pa.array(columns[0][row] - 1))
    yield pa.RecordBatch.from_arrays([langs, *words, pa.array(total)], ["lang", *NAMES, "a"])


def bitmap(keys: DataFrame) -> bytes:
    """Bitmap of ``BITS`` bits over the lowest bits of the long column ``key``: a fixed size,
    built by partial aggregation."""
    slot = F.col("key").bitwiseAND(F.lit(BITS - 1)) + 1
    made = keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).toArrow()
    out = bytearray(BITS // 8)
    for k, bits in zip(made["bucket"].to_pylist(), made["bits"].to_pylist(), strict=True):
        out[(k - 1) * 4096:k * 4096] = bits
    return bytes(out)


def _score(a: str, parts: str) -> Column:
    return F.expr(f"cast((cast(2000000 as decimal(10,0)) * cast({a} as decimal(19,0))) div cast({parts} as decimal(20,0)) as bigint)")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``top`` phrases of each language."""
    spark = df.sparkSession
    tune(spark)
    docs = df.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
                     F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"))
    words = docs.mapInArrow(_words, "lang string, word string, h long, key long, n long")
    words = written(words.groupBy("lang", "word", "h", "key").agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))  # a row for each language
    words = words.where(F.col("n") >= LEAST)
    share = spark.sparkContext.broadcast
    frequent = share(bitmap(words))
    pairs = docs.mapInArrow(_pairs(frequent), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    leading = share(bitmap(pairs.where(F.col("n") >= LEAST)))

    columns = ", ".join(f"{c} long" for c in NAMES)
    suffixes = written(docs.mapInArrow(_suffixes(frequent, leading), f"lang string, {columns}, n long"), "suffixes")
    two = suffixes.groupBy("lang", "w1", "w2").agg(F.sum("n").alias("a")).where(F.col("a") >= LEAST)
    two = two.select("lang", F.array("w1", "w2").alias("w"), "a")
    long = suffixes.where("w3 != 0")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-long.count() // ROUTED))
    more = long.repartition(tasks, "lang", "w1", "w2", "w3").mapInArrow(_sorted, f"lang string, {columns}, a long")
    more = more.select("lang", F.filter(F.array(*NAMES), lambda x: x != 0).alias("w"), "a")
    found = written(two.unionByName(more), "phrases")

    counts = found.select("lang", F.col("w").alias("part"), F.col("a").alias("f")).unionByName(
        words.select("lang", F.array("h").alias("part"), F.col("n").alias("f")))
    cuts = found.select("lang", "w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(True).alias("first"), F.expr("slice(w, 1, k)").alias("part")),
                    F.struct(F.lit(False).alias("first"), F.expr("slice(w, k + 1, size(w) - k)").alias("part")))
    parts = cuts.select("lang", "w", "a", "k", F.inline(sides)).join(counts, ["lang", "part"])
    cut = parts.groupBy("lang", "w", "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"),
                                                   F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    cut = cut.withColumn("score", _score("a", "l + r"))
    scored = cut.groupBy("lang", "w", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = found.where(F.size("w") > 2).select(
        "lang", F.col("a").alias("f"), F.explode(F.expr(
            "flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> slice(w, i, m))))")).alias("w"))
    inner = inner.groupBy("lang", "w").agg(F.max("f").alias("longer"))
    left = scored.join(inner, ["lang", "w"], "left").where("longer is null or 100 * cast(longer as decimal(20,0)) < 80 * cast(a as decimal(20,0))")

    spelt = left.select("lang", "w", "a", "cut", F.posexplode("w").alias("at", "h")).join(words.select("lang", "h", "word"), ["lang", "h"])
    spelt = spelt.groupBy("lang", "w", "a", "cut").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    ranked = spelt.select("lang", F.array_join("spelt.word", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the first of 64 parts of a language before the first of the language
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    ranked = ranked.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return lookup_join(ranked, totals, ["lang"]).select("lang", F.col("rank").cast("long").alias("rank"), 
        "phrase", "a", "l", "r", "n", "score")
