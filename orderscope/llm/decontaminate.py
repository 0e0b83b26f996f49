"""Operator 6: benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``WINDOW`` words (an item of fewer words is one
window).  A window is found in a document when all its 3-word shingles stand
there in order; at that containment (1.0) the necessary prefix of the window's
shingles, ordered by rarity, is its rarest one.

1. ``rarity``: one pass over all documents counts the items' shingles (each task
   adds up its own, so at most one row a task and shingle is shuffled).
2. Each distinct window is indexed under its rarest shingle only.
3. A second pass looks the documents' shingles up in that index.  The place of
   the shingle in the window fixes where the window would start and end (position
   and length bounds: it must lie inside the document); what remains is verified
   word by word, on the words themselves.

The items are a stated query set: they go to the tasks in blocks of about
``BLOCK_BYTES`` of text.  One block is a lookup column: documents are never shuffled,
however often a passage occurs.  With several, each block has its own passes, which
write the hits of the distinct texts that have any (by SHA-256 of the text); its
windows leave driver and workers before the next block.  The hits of all blocks are merged by
text, written and joined to the documents, where AQE can split the partition of a text with
very many copies.

Defined results: null and empty texts have no words; items without words have no
windows; repeated items count once by their id, a null id reads as an empty
string; repeated documents get equal rows; an empty benchmark finds nothing.
Clashing output names replace the input's.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .common import written

WINDOW, SHINGLE = 13, 3
BLOCK_BYTES = 2 << 20
_BITS = 1 << 22
_FOLD_BYTES = bytes(textvec.FOLD)

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", _SPANS),
    T.StructField("items", T.ArrayType(T.StringType())),
])


_FOUND = T.StructType([T.StructField("key", T.StringType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])


class Windows:
    """The distinct windows of a block of items: word hashes, words and items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        found: dict[bytes, int] = {}
        self.items: list[set[str]] = []
        self.text: list[bytes] = []
        hashes: list[np.ndarray] = []
        for item, text in items:
            w = textvec.words(pa.array([text or ""]), textvec.ALNUM)
            raw = w.buf.tobytes().translate(_FOLD_BYTES)
            tokens = [raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
            size = min(window, len(tokens))
            for at in range(len(tokens) - size + 1 if size else 0):
                key = b" ".join(tokens[at:at + size])
                k = found.setdefault(key, len(found))
                if k == len(self.items):
                    self.items.append(set())
                    self.text.append(key)
                    hashes.append(w.hash[at:at + size])
                self.items[k].add(item)
        self.size = np.array([len(h) for h in hashes], np.int64)
        self.hashes = np.zeros((len(hashes), window), np.uint64)
        for k, h in enumerate(hashes):
            self.hashes[k, :len(h)] = h
        self.shingles = {k: textvec.shingles(h, min(SHINGLE, len(h))) for k, h in enumerate(hashes)}
        self.sizes = sorted({min(SHINGLE, n) for n in self.size.tolist()})

    def vocabulary(self) -> dict[int, np.ndarray]:
        """The distinct shingles of each shingle size."""
        out = {}
        for s in self.sizes:
            own = [self.shingles[k] for k in range(len(self.size)) if min(SHINGLE, self.size[k]) == s]
            out[s] = np.unique(np.concatenate(own))
        return out


class Lookup:
    """Finds the places of a fixed set of 64-bit keys in an array of hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.maybe = np.zeros(_BITS, bool)
        self.maybe[self._slot(self.keys)] = True

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return (x & np.uint64(_BITS - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose hash is a key, and the key's number."""
        if not len(self.keys) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[self._slot(hashes)])
        k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[k] == hashes[at]
        return at[same], k[same]


def _clean_places(w: textvec.Words, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs of ``size`` words from word ``at`` lie inside one text; the text's number."""
    text = np.searchsorted(w.first, at, "right") - 1
    inside = (at >= 0) & (text >= 0) & (text < len(w.first) - 1)
    text = np.where(inside, text, 0)
    return inside & (at + size <= w.first[text + 1]), text


def rarity(df: DataFrame, windows: Windows, text: str) -> dict[tuple[int, int], int]:
    """How often each of the block's shingles stands in all documents."""
    lookups = {s: Lookup(v) for s, v in windows.vocabulary().items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {s: np.zeros(len(x.keys), np.int64) for s, x in lookups.items()}
        for batch in batches:
            w = textvec.words(batch.column(0), textvec.ALNUM)
            for s, x in lookups.items():
                at, k = x.find(textvec.shingles(w.hash, s))
                ok, _ = _clean_places(w, at, np.full(len(at), s))
                total[s] += np.bincount(k[ok], minlength=len(x.keys))
        for s, n in total.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(int((n > 0).sum()), s)), pa.array(np.flatnonzero(n)), pa.array(n[n > 0])],
                ["s", "k", "n"])

    rows = df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "s long, k long, n long")
    rows = written(rows.groupBy("s", "k").agg(F.sum("n").alias("n")), "rarity")
    return {(r.s, int(lookups[r.s].keys[r.k])): r.n for r in rows.collect()}  # a row for each shingle of the block


class Index:
    """The windows under their rarest shingles."""

    def __init__(self, windows: Windows, counts: dict[tuple[int, int], int]):
        self.windows = windows
        under: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, own in windows.shingles.items():
            s = min(SHINGLE, int(windows.size[k]))
            rarest = min(range(len(own)), key=lambda j: (counts.get((s, int(own[j])), 0), int(own[j])))
            under[s][int(own[rarest])].append((k, rarest))
        self.parts = []
        for s, keys in under.items():
            lookup = Lookup(np.array(list(keys), np.uint64))
            rows = [keys[int(x)] for x in lookup.keys]
            size = np.array([len(r) for r in rows])
            flat = np.array([x for r in rows for x in r], np.int64)
            self.parts.append((s, lookup, np.cumsum(size) - size, size, flat[:, 0], flat[:, 1]))

    def hits(self, w: textvec.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Verified (text, first word in all, window)."""
        texts, places, found = [], [], []
        win = self.windows
        for s, lookup, start, size, window, offset in self.parts:
            at, k = lookup.find(textvec.shingles(w.hash, s))
            n = size[k]
            own = np.arange(int(n.sum())) + np.repeat(start[k] - (np.cumsum(n) - n), n)
            cand = window[own]
            place = np.repeat(at, n) - offset[own]
            ok, text = _clean_places(w, place, win.size[cand])
            cand, place, text = cand[ok], place[ok], text[ok]
            step = np.arange(win.hashes.shape[1])
            inside = step < win.size[cand][:, None]
            seen = w.hash[np.minimum(place[:, None] + step, max(len(w.hash) - 1, 0))] if len(place) else win.hashes[:0]
            ok = ((seen == win.hashes[cand]) | ~inside).all(1)
            cand, place, text = cand[ok], place[ok], text[ok]
            ok = np.array([self._same(w, p, c) for p, c in zip(place.tolist(), cand.tolist(), strict=True)], bool)
            texts.append(text[ok])
            places.append(place[ok])
            found.append(cand[ok])
        if not texts:
            return (np.zeros(0, np.int64),) * 3
        return np.concatenate(texts), np.concatenate(places), np.concatenate(found)

    def _same(self, w: textvec.Words, place: int, window: int) -> bool:
        last = place + int(self.windows.size[window])
        words = [w.buf[a:b].tobytes() for a, b in zip(w.start[place:last], w.end[place:last], strict=True)]
        return b" ".join(words).translate(_FOLD_BYTES) == self.windows.text[window]

    def rows(self, arr: pa.Array) -> list[dict]:
        w = textvec.words(arr, textvec.ALNUM)
        text, place, window = self.hits(w)
        place = place - w.first[text]
        out = [{"n_words": n, "spans": [], "items": set()} for n in w.counts.tolist()]
        order = np.lexsort((place, text))
        for t, p, k in zip(text[order].tolist(), place[order].tolist(), window[order].tolist(), strict=True):
            spans, end = out[t]["spans"], p + int(self.windows.size[k])
            if spans and p <= spans[-1]["end"]:
                spans[-1]["end"] = max(end, spans[-1]["end"])
            else:
                spans.append({"start": p, "end": end})
            out[t]["items"] |= self.windows.items[k]
        for row in out:
            row["items"] = sorted(row["items"])
        return out


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


@F.arrow_udf(_SPANS)
def _merged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Sorted spans (of several blocks) as the maximal runs that they cover."""
    for arr in batches:
        out = []
        for found in arr.to_pylist():
            spans: list[dict] = []
            for x in found:
                if spans and x["start"] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(x["end"], spans[-1]["end"])
                else:
                    spans.append(dict(x))
            out.append(spans)
        yield pa.array(out, _arrow(_SPANS))


@F.arrow_udf(T.LongType())
def _word_count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for arr in batches:
        yield pa.array(textvec.words(arr, textvec.ALNUM).counts, pa.int64())


def _hits_of(index: Index):
    """The rows (key, spans, items) of the texts with hits."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"key": k, "spans": r["spans"], "items": r["items"]}
                    for k, r in zip(batch.column(0).to_pylist(), index.rows(batch.column(1)), strict=True) if r["items"]]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(f.name, _arrow(f.dataType)) for f in _FOUND]))
    return find


def _finder(index: Index):
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array(index.rows(arr), _arrow(HITS))
    return F.arrow_udf(find, HITS)


def _index(df: DataFrame, items: DataFrame, text: str) -> Index:
    """The index of a block of items (id, text), which is collected."""
    windows = Windows([(r.id, r.text) for r in items.orderBy("id", "text").collect()])
    return Index(windows, rarity(df, windows, text) if len(windows.size) else {})


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", out: str = "hits") -> DataFrame:
    """Add ``out``: n_words, the merged word spans that windows cover, and the
    ids (as strings, sorted) of the items that they come from."""
    items = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("id"),
                             F.col(f"`{item_text}`").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    whole = F.col(f"`{text}`").cast("string")
    if blocks == 1:
        return df.withColumn(out, _finder(_index(df, items, text))(whole))

    parts = []
    keyed = df.select(F.sha2(whole, 256).alias("key"), whole.alias("text")).where("key is not null")
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        found = keyed.mapInArrow(_hits_of(_index(df, own, text)), _FOUND)
        # equal texts have equal hits
        parts.append(written(found.groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "hits"))
    every = reduce(DataFrame.union, parts).groupBy("key").agg(  # at most one row a block and text
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    taken = {c.lower() for c in df.columns}
    key, spans, names = (next(c for i in range(len(taken) + 1) if (c := f"_{n}{i}") not in taken) for n in ("key", "spans", "items"))
    every = written(every.select(F.col("key").alias(key), _merged("spans").alias(spans), F.col("items").alias(names)), "hits")
    hit = F.struct(_word_count(whole).alias("n_words"), F.coalesce(spans, F.array().cast(_SPANS)).alias("spans"),
                   F.coalesce(names, F.array().cast("array<string>")).alias("items"))
    rows = df.withColumn(key, F.sha2(whole, 256)).join(every, key, "left")
    return rows.withColumn(out, hit).drop(key, spans, names).select(df.withColumn(out, F.lit(0)).columns)  # its order of columns


def covered(hits: str = "hits"):
    """Words inside the spans."""
    return F.aggregate(f"{hits}.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(hits: str = "hits"):
    """At least one word in twenty is covered."""
    n = covered(hits)
    return (n > 0) & (20 * n >= F.col(f"{hits}.n_words"))
