"""Operator 5: licence scan by an exact set-similarity join.

A block is a window of words; one begins at every word (``STEP`` = 1), however lines
are broken.  Its length comes from the template: twice its words, but ``BLOCK`` at
least (``window``).  A block matches a template if it holds at least ``percent`` of
the template's distinct words.

1. ``frequencies``: one pass counts the templates' words over all documents (at
   most one row a task and word is shuffled).
2. Words are ordered globally by that count, rarest first.  To reach the needed
   overlap o of |T| words, a block must hold one of the first |T| - o + 1 words of
   the template (prefix filter); these words index the templates.
3. A second pass looks the documents' words up in that index.  Only blocks around a
   prefix word are counted, and only if the batch holds o of the template's words.
   A word at place p counts for the blocks that begin after its last place before p,
   at most one window before p; these ranges of one word are disjoint, so the running
   sum of their ends is the number of distinct words of every block, exact for all
   starts at once.

Templates are short notices and whole paragraphs of licence texts
(``licence_paragraphs.tsv``).  Fixed phrases are found word by word beside this.  The
templates are a fixed small set and travel with the tasks; documents are not shuffled.

Defined results: null and empty texts have no words and no labels; repeated rows
get equal rows; an empty table gives none; an output column that the input has is
replaced.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import textvec
from .common import written
from .decontaminate import Lookup

BLOCK, STEP = 64, 1

PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Short notices of public licences.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions "
     "of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at",
     "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software", "bsd-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("all rights reserved", "all-rights-reserved"),
)

#: Whole licence texts by paragraph (headings and other paragraphs of under 25 words stand with
#: the next one).  Paragraphs that versions share carry the family's label: gpl, lgpl, gfdl, gnu, mpl.
PARAGRAPHS = tuple((words, label) for label, words in (
    line.split("\t") for line in pkgutil.get_data(__package__, "licence_paragraphs.tsv").decode().splitlines()))


def window(words: int) -> int:
    """Words of a block for a template of so many words."""
    return max(BLOCK, 2 * words)


_BLOCKS = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("containment", T.DoubleType())]))

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("places", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("word", T.LongType())]))),
    T.StructField("blocks", _BLOCKS),
    T.StructField("paragraphs", _BLOCKS),
])


class Join:
    """Templates in the global order of their words, and the index of their prefixes."""

    def __init__(self, templates, phrases, counts: dict[int, int], percent: int, paragraphs=()):
        self.notices = len(templates)
        templates = (*templates, *paragraphs)
        self.labels = [label for _, label in templates]
        lists = [textvec.phrase(t) for t, _ in templates]
        sets = [np.unique(x) for x in lists]
        every = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        rank = sorted(range(len(every)), key=lambda k: (counts.get(int(every[k]), 0), int(every[k])))
        place = np.empty(len(every), np.int64)
        place[rank] = np.arange(len(every))
        self.lookup, self.order = Lookup(every), place
        self.sets = [np.sort(place[np.searchsorted(every, s)]) for s in sets]
        self.need = [-(-percent * len(s) // 100) for s in sets]
        self.window = [window(len(x)) for x in lists]
        self.under: dict[int, list[int]] = {}
        for t, (s, need) in enumerate(zip(self.sets, self.need, strict=True)):
            for tok in s[:len(s) - need + 1].tolist():
                self.under.setdefault(tok, []).append(t)
        self.phrases = [(textvec.phrase(p), label) for p, label in phrases]

    def places(self, w: textvec.Words, text: np.ndarray) -> list[tuple[int, int, str]]:
        """(text, word, label) of each place where a phrase's words stand consecutively."""
        out = []
        for words, label in self.phrases:
            n = len(words)
            if not 0 < n <= len(w.hash):
                continue
            at = np.flatnonzero(w.hash[:len(w.hash) - n + 1] == words[0])
            for j in range(1, n):
                at = at[w.hash[at + j] == words[j]]
            at = at[text[at] == text[at + n - 1]]
            out += zip(text[at].tolist(), (at - w.first[text[at]]).tolist(), [label] * len(at), strict=True)
        return sorted(out)

    def blocks(self, w: textvec.Words, text: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, template, start, end, words held) of each matching block, by text and start."""
        at, k = self.lookup.find(w.hash)
        token = self.order[k]
        by = np.argsort(token, kind="stable")  # places of each word, in order
        begin = np.searchsorted(token[by], np.arange(len(self.order) + 1))
        present = np.diff(begin) > 0
        hot: dict[int, list[np.ndarray]] = {}
        for tok in np.flatnonzero(present).tolist():
            for t in self.under.get(tok, ()):
                hot.setdefault(t, []).append(at[by[begin[tok]:begin[tok + 1]]])
        out = [np.zeros((5, 0), np.int64)]
        for t, places in hot.items():
            words, need = self.sets[t], self.need[t]
            if int(present[words].sum()) < need:
                continue
            start, held = self._starts(t, np.sort(np.concatenate(places)), at, token, w.first, text)
            d = text[start]
            end = np.minimum(start + self.window[t], w.first[d + 1])
            out.append(np.stack([d, np.full(len(d), t), start - w.first[d], end - w.first[d], held]))
        found = np.concatenate(out, axis=1)
        return tuple(found[:, np.lexsort((found[1], found[2], found[0]))])

    def _starts(self, t: int, hot: np.ndarray, at: np.ndarray, token: np.ndarray, first: np.ndarray,
                text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts of the blocks that match template ``t``, and how many of its words they hold.
        ``hot``: places of its prefix words, one of which every such block holds."""
        words, need, size = self.sets[t], self.need[t], self.window[t]
        # all template words that share a block with a prefix word
        lo, hi = np.searchsorted(at, hot - size, "right"), np.searchsorted(at, hot + size)
        near = np.zeros(len(at) + 1, np.int64)
        np.add.at(near, lo, 1)
        np.add.at(near, hi, -1)
        near = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        slot = np.minimum(np.searchsorted(words, token[near]), len(words) - 1)
        near, slot = near[words[slot] == token[near]], slot[words[slot] == token[near]]
        p = at[near]
        by = np.argsort(slot, kind="stable")
        before = np.full(len(p), -1, np.int64)  # the last place of the same word
        same = slot[by[1:]] == slot[by[:-1]]
        before[by[1:][same]] = p[by[:-1][same]]
        lo = np.maximum(np.maximum(p - size, before) + 1, first[text[p]])
        edge, place = np.unique(np.concatenate([lo, p + 1]), return_inverse=True)
        held = np.bincount(place[:len(p)], minlength=len(edge)) - np.bincount(place[len(p):], minlength=len(edge))
        held = np.cumsum(held)[:-1]
        full = np.flatnonzero(held >= need)
        length = edge[full + 1] - edge[full]
        start = np.repeat(edge[full] - np.cumsum(length) + length, length) + np.arange(length.sum())
        return start, np.repeat(held[full], length)

    def rows(self, arr: pa.Array) -> pa.Array:
        w = textvec.words(arr, textvec.ALNUM)
        text, n = w.texts(), len(arr)

        def lists(d, names: list[str], *columns) -> pa.Array:
            off = pa.array(np.searchsorted(d, np.arange(n + 1)), pa.int32())
            return pa.ListArray.from_arrays(off, pa.StructArray.from_arrays(columns, names))

        places = self.places(w, text)
        out = [pa.array(w.counts, pa.int64()), lists(
            np.array([x[0] for x in places], np.int64), ["label", "word"],
            pa.array([x[2] for x in places], pa.string()), pa.array([x[1] for x in places], pa.int64()))]
        found = np.stack(self.blocks(w, text))
        labels, sizes = pa.array(self.labels, pa.string()), np.array([len(s) for s in self.sets], np.int64)
        for some in (found[1] < self.notices, found[1] >= self.notices):
            d, t, start, end, held = found[:, some]
            out.append(lists(d, ["label", "start", "end", "containment"], labels.take(pa.array(t)), pa.array(start),
                             pa.array(end), pa.array(held / sizes[t])))
        return pa.StructArray.from_arrays(out, FOUND.names).cast(to_arrow_type(FOUND))


def frequencies(df: DataFrame, templates, text: str) -> dict[int, int]:
    """How often each word of the templates stands in all documents."""
    lookup = Lookup(np.unique(np.concatenate([textvec.phrase(t) for t, _ in templates])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lookup.keys), np.int64)
        for batch in batches:
            _, k = lookup.find(textvec.words(batch.column(0), textvec.ALNUM).hash)
            total += np.bincount(k, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["k", "n"])

    rows = df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(count, "k long, n long")
    rows = written(rows.groupBy("k").agg(F.sum("n").alias("n")), "license-words")
    return {int(lookup.keys[r.k]): r.n for r in rows.collect()}  # a row for each word of the templates


def scan(df: DataFrame, text: str = "text", out: str = "licenses", templates=TEMPLATES, phrases=PHRASES,
         percent: int = 90, paragraphs=PARAGRAPHS) -> DataFrame:
    """Add ``out``: n_words, the phrases' places, and the blocks that match a template or a paragraph."""
    every = (*templates, *paragraphs)
    counts = frequencies(df, every, text) if every else {}
    join = Join(templates, phrases, counts, percent, paragraphs)

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield join.rows(arr)

    return df.withColumn(out, F.arrow_udf(find, FOUND)(F.col(f"`{text}`").cast("string")))
