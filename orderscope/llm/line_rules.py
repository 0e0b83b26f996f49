"""Operator 4: line-first cleaning with built-in functions only.

Every line is judged by itself; lines that fail a rule go:

* navigation: three or more ``|`` or bullet separators, at least one in ``SPREAD`` characters,
* symbols: more than one in ten characters of the line is a markup symbol,
* punctuation: three or more runs of doubled exclamation or question marks, at least
  one in ``SPREAD`` characters, or ten or more words without any punctuation mark at all,
* boilerplate: one of the phrases of page furniture (``BOILERPLATE``) in a line of at most
  ``SHORT_LINE`` characters.

So no rule takes a long line of running text for one phrase or a few marks, and every rule
reads a line a fixed number of times, whatever is in it.

A document fails if less than half of its text is left, or if it fails the base
rules (fewer than 50 words, or more than half of its words in repeated 3-word
windows).

All of it is one projection over a row's own arrays: no shuffle, no Python.
Repeated windows are found by sorting (64-bit hash, position) pairs of a text,
only where its hashes are not all distinct; neighbours of equal hash are compared
word by word, so different windows never count as repeated.

Arrays that are used more than once are bound as lambda variables (``_let``), so
they are computed once a row.

Defined results: a null text reads as an empty one, and both fail the base rules;
repeated rows get equal rows; an output column that the input has is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Phrases of page furniture, lower case.
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
               "enable javascript", "click here", "subscribe to our", "sign up for", "powered by", "lorem ipsum",
               "skip to content", "back to top")
MIN_WORDS, MIN_LEFT_PERCENT = 50, 50
SPREAD, SHORT_LINE = 200, 400


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(w: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more."""
    n = F.size(w)

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(F.array_sort(places), start, lambda a, x: F.struct(
            (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    def same(a: Column, b: Column) -> Column:
        i, j = a["i"], b["i"]
        equal = a["h"] == b["h"]
        for k in range(3):
            equal = equal & (F.get(w, i + k) == F.get(w, j + k))
        return F.coalesce(equal, F.lit(False))

    def places(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(pairs, lambda s: F.transform(
            F.filter(s, lambda e, k: same(e, F.get(s, k + 1)) | same(e, F.get(s, k - 1))), lambda e: e["i"]))

    def of(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(places(h)))

    hashes = F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))),
                         lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return _let(hashes, of)


def _left(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column) -> Column:
    """Whether one line fails a rule."""
    low = F.lower(line)
    size = F.char_length(line)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | F.contains(low, F.lit(phrase))
    separators = _left(line, r"[^|»›•]+")
    navigation = (separators >= 3) & (SPREAD * separators >= size)
    symbols = 10 * _left(line, r"[^#*$%&|<>{}~^=_+\\]+") > size
    runs = F.regexp_count(line, F.lit(r"[!?]{2,}"))
    shouting = (runs >= 3) & (SPREAD * runs >= size)
    endless = ~line.rlike(r"[.,;:!?…。，！？]") & line.rlike(r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){9}[^\x20\x09-\x0D]")
    return (size > 0) & (navigation | symbols | shouting | endless | (boilerplate & (size <= SHORT_LINE)))


def clean(df: DataFrame, text: str = "text", out: str = "rules") -> DataFrame:
    """Add ``out``: a struct of the base counts, the lines left (``text``), their
    share and the verdicts ``base_failed`` and ``kept``."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))

    def result(t: Column) -> Column:
        words = F.filter(F.split(t, SPACE), lambda x: x != "")
        lines = F.split(t, "\n")
        of_words = _let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).alias("n_repeat_words")))
        of_lines = _let(lines, lambda ls: F.struct(
            _let(F.filter(ls, lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
                 lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.char_length(F.array_join(ls, "")).cast("long").alias("chars"),
            F.filter(ls, lambda x: ~line_fails(x)).alias("left")))
        return F.struct(of_words.alias("w"), of_lines.alias("l"),
                        _left(t, r"[^#*$%&|<>]+").cast("long").alias("n_symbols"))

    parts = df.withColumn(out, _let(whole, result))
    w, ls = F.col(f"`{out}`.w"), F.col(f"`{out}`.l")
    base_failed = (w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > 50 * w["n_words"])
    left = F.char_length(F.array_join(ls["left"], "")).cast("long")
    return parts.withColumn(out, F.struct(
        w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"),
        F.col(f"`{out}`.n_symbols").alias("n_symbols"), ls["n_dup_lines"].alias("n_dup_lines"),
        w["n_repeat_words"].alias("n_repeat_words"), base_failed.alias("base_failed"),
        F.array_join(ls["left"], "\n").alias("text"), left.alias("chars_left"), ls["chars"].alias("chars"),
        (~base_failed & (100 * left >= MIN_LEFT_PERCENT * ls["chars"])).alias("kept")))
