"""Operator 1: token ids as a wavelet matrix per shard.

``write(df, ...)`` encodes every whole text, appends an end id, and writes the ids
in ascending id order of the documents as shards; it returns the manifest, one row
a shard with the position of its first token among all.  ``read`` gives the
documents back from the files alone.

A shard is one file: a header, the succinct bit-planes of its token sequence
(bit ``levels - 1 - k`` of each token in plane k, tokens stably parted by the bits
before), rank counts every 512 bits, and the table of documents.  A token of a
16-bit vocabulary takes 16 bits and 2 for the ranks.  ``WaveletMatrix`` answers
access (token at a position), rank (occurrences of a token before a position) and
select (position of its k-th occurrence) from the planes.

Documents are dealt out by ranges of their ids and sorted inside each range; a
task holds one shard at most (``SHARD_TOKENS``, and at least one document).

Encoding: no token of the vocabulary spans white space, which its splitter drops,
and neither NFC nor lower-casing acts across ASCII white space.  So a text is cut
there, and each distinct piece of a batch goes to the tokenizers library once; the
ids of the whole text are those of its pieces in order.  Pieces of characters
below U+0180 need no normaliser beyond lower-casing; they are split by the
tokenizer's pattern and each distinct word goes to its model.  Pieces are told
apart by a hash and then compared byte by byte.

Defined results: null and empty texts have the end id only; repeated rows are
written each time, those of one id in text order; null ids come first; an empty
table gives no shard.  Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .common import shared_path, written
from .files import opened, own_name

MAGIC = b"OSWM0001"
BLOCK = 64  # bytes between stored ranks
SHARD_TOKENS = 1 << 24
#: Pieces and words whose ids a worker keeps; the rest is encoded again.
MEMO_ENTRIES, MEMO_WORDS = 800_000, 400_000
#: Longer pieces are not remembered, so the memo is bounded in bytes too.
MEMO_BYTES = 64


class WaveletMatrix:
    """Bit-planes of a sequence of numbers below ``2**levels``."""

    def __init__(self, n: int, levels: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.levels, self.planes, self.zeros, self.ranks = n, levels, planes, zeros, ranks

    @classmethod
    def build(cls, values: np.ndarray, levels: int) -> WaveletMatrix:
        dtype = np.uint16 if levels <= 16 else np.uint32
        now = values.astype(dtype)
        planes, zeros, ranks = [], [], []
        for b in reversed(range(levels)):
            bits = (now & dtype(1 << b)) != 0
            plane = np.packbits(bits, bitorder="little")
            planes.append(plane)
            ranks.append(_ranks(plane))
            low, high = now[~bits], now[bits]
            zeros.append(len(low))
            now = np.concatenate([low, high])
        return cls(len(values), levels, planes, zeros, ranks)

    def all(self) -> np.ndarray:
        """The whole sequence, planes undone from the last to the first."""
        dtype = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, dtype)
        for b, plane, zeros in zip(range(self.levels), reversed(self.planes), reversed(self.zeros), strict=True):
            bits = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, dtype)
            above[~bits] = now[:zeros]
            above[bits] = now[zeros:] | dtype(1 << b)
            now = above
        return now

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (i & 7) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones before position i in plane k."""
        block, byte = i // (8 * BLOCK), i >> 3
        n = int(self.ranks[k][block]) + int(np.bitwise_count(self.planes[k][block * BLOCK:byte]).sum())
        return n + (int(self.planes[k][byte]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else n

    def _place(self, k: int, bit: int, count: int) -> int:
        """Position of the count-th (from 0) ``bit`` in plane k."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(k, mid + 1)
            if (ones if bit else mid + 1 - ones) > count:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        """The value at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.levels):
            bit, ones = self._bit(k, i), self._ones(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _down(self, value: int, i: int) -> tuple[int, int]:
        lo = 0
        for k in range(self.levels):
            a, b = self._ones(k, lo), self._ones(k, i)
            if value >> (self.levels - 1 - k) & 1:
                lo, i = self.zeros[k] + a, self.zeros[k] + b
            else:
                lo, i = lo - a, i - b
        return lo, i

    def rank(self, value: int, i: int | None = None) -> int:
        """Occurrences of ``value`` before position i (in all, without i)."""
        if value >> self.levels:
            return 0
        lo, hi = self._down(value, self.n if i is None else i)
        return hi - lo

    def select(self, value: int, count: int) -> int:
        """Position of occurrence ``count`` (from 0) of ``value``."""
        if not 0 <= count < self.rank(value):
            raise IndexError(count)
        i = self._down(value, self.n)[0] + count
        for k in reversed(range(self.levels)):
            bit = value >> (self.levels - 1 - k) & 1
            i = self._place(k, bit, i - self.zeros[k] if bit else i)
        return i


def _ranks(plane: np.ndarray) -> np.ndarray:
    """Ones before each block, and in all."""
    n = -(-len(plane) // BLOCK)
    whole = np.zeros(n * BLOCK, np.uint8)
    whole[:len(plane)] = plane
    each = np.bitwise_count(whole.view(np.uint64)).reshape(n, BLOCK // 8).sum(1, dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])


def save(out, tokens: np.ndarray, levels: int, ids: list[int | None], ends: np.ndarray) -> None:
    """One shard: header, zeros, planes each with its ranks, documents."""
    w = WaveletMatrix.build(tokens, levels)
    out.write(MAGIC + struct.pack("<QIQ", w.n, levels, len(ids)))
    out.write(np.array(w.zeros, "<u8").tobytes())
    for plane, ranks in zip(w.planes, w.ranks, strict=True):
        out.write(plane.tobytes())
        out.write(ranks.astype("<u8").tobytes())
    out.write(np.array([x is None for x in ids], np.uint8).tobytes())
    out.write(np.array([x or 0 for x in ids], "<i8").tobytes())
    out.write(ends.astype("<u8").tobytes())


def load(raw: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, document ids and token ends of a shard's bytes."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token shard")
    n, levels, docs = struct.unpack_from("<QIQ", raw, 8)
    at = 8 + struct.calcsize("<QIQ")

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(raw, dtype, count, at)
        at += x.nbytes
        return x

    zeros = take("<u8", levels).tolist()
    size = -(-n // 8)
    planes, ranks = [], []
    for _ in range(levels):
        planes.append(take("u1", size))
        ranks.append(take("<u8", -(-size // BLOCK) + 1))
    null = take("u1", docs)
    ids = [None if m else i for m, i in zip(null.tolist(), take("<i8", docs).tolist(), strict=True)]
    return WaveletMatrix(n, levels, planes, zeros, ranks), ids, take("<u8", docs).astype(np.int64)


# The normaliser and splitter that the fast path stands for; a file that
# says anything else is left to the library whole.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: The same splitter here, and the texts that need no normaliser but lower case.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
PLAIN = re.compile("[\\x00-\u012f\u0131-\u017f]*").fullmatch
#: Byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class TextEncoder:
    """Ids of whole texts from a tokenizers file, as its library gives them without adding
    special tokens: distinct pieces once, texts that hold a string of an added token by
    the library itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        self.known = spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == SPLITTER \
            and not any(t["normalized"] for t in added)
        self.added = [t["content"] for t in added]
        self.levels = max(1, (self.tokenizer.get_vocab_size(True) - 1).bit_length())
        self.memo: dict[bytes, bytes] = {}

        self.words: dict[str, bytes] = {}
        self.model = self.tokenizer.model

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            plain = word.isascii() and word.isprintable()
            level = word if plain else word.encode().decode("latin-1").translate(BYTE_LEVEL)
            got = array("I", [t.id for t in self.model.tokenize(level)]).tobytes()
            if len(word) <= MEMO_BYTES:
                if len(self.words) >= MEMO_WORDS:
                    self.words.clear()
                self.words[word] = got
        return got

    def _plain(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces of plain texts, given with A-Z folded."""
        out = list(map(self.memo.get, pieces))
        for k, piece in enumerate(pieces):
            if out[k] is None:
                text = piece.decode()
                if text.isascii() and text.isalpha():
                    out[k] = self._word(text)
                else:
                    out[k] = b"".join([self._word(w) for w in WORD(text.lower())])
                if len(piece) <= MEMO_BYTES:
                    if len(self.memo) >= MEMO_ENTRIES:
                        self.memo.clear()
                    self.memo[piece] = out[k]
        return out

    def _plain_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and their number for each text; each distinct piece is encoded once."""
        w = textvec.words(pa.array(texts, pa.string()), textvec.SPACED)
        if not len(w.hash):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        folded = textvec.FOLD[w.buf]
        _, first, code = np.unique(w.hash, return_index=True, return_inverse=True)
        size = w.end - w.start
        own, other = _runs(w.start, size), _runs(w.start[first][code], size)
        if not (size == size[first][code]).all() or not (folded[own] == folded[other]).all():
            return self._any_texts(texts)  # two pieces of one hash
        raw = folded.tobytes()
        ids = self._plain([raw[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)])
        n = np.array([len(x) for x in ids], np.int64) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)[_runs((np.cumsum(n) - n)[code], n[code])]
        ends = np.concatenate([[0], np.cumsum(n[code])])
        return flat, np.diff(ends[w.first])

    def _any_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any texts, piece by piece."""
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        number: dict[str, int] = {}
        code = np.array([number.setdefault(p, len(number)) for p in chain.from_iterable(cut)], np.int64)
        rare = [p for p in number if not PLAIN(p)]
        found = dict(zip(rare, self.tokenizer.encode_batch(rare, add_special_tokens=False), strict=True))
        ids = [array("I", found[p].ids).tobytes() if p in found else b"".join([self._word(w) for w in WORD(p.lower())])
               for p in number]
        n = np.array([len(x) for x in ids], np.int64) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)[_runs((np.cumsum(n) - n)[code], n[code])]
        ends = np.concatenate([[0], np.cumsum(n[code])])
        return flat, np.diff(ends[np.concatenate([[0], np.cumsum([len(c) for c in cut])])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and their number for each text."""
        kind = np.array([2 if not self.known or any(x in t for x in self.added) else int(PLAIN(t) is None) for t in texts], np.int8)
        ways = (self._plain_texts, self._any_texts, self._library)
        if not kind.any():
            return self._plain_texts(texts)
        parts = {k: ways[k]([t for t, p in zip(texts, kind, strict=True) if p == k]) for k in np.unique(kind).tolist()}
        counts = np.empty(len(texts), np.int64)
        for k, (_, n) in parts.items():
            counts[kind == k] = n
        out = np.empty(int(counts.sum()), np.uint32)
        of = np.repeat(kind, counts)
        for k, (ids, _) in parts.items():
            out[of == k] = ids
        return out, counts

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the library, text by text."""
        found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), np.uint32), np.array([len(x) for x in found], np.int64)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all runs start, start + 1, ... of the given sizes, joined."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def _with_end(flat: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    out = np.empty(len(flat) + len(counts), np.uint32)
    last = np.cumsum(counts + 1) - 1
    body = np.ones(len(out), bool)
    body[last] = False
    out[body] = flat
    out[last] = end_id
    return out


def write(df: DataFrame, path: str, end_id: int, id: str = "doc_id", text: str = "text",
          folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards to ``folder`` (a fresh shared one by default); the manifest:
    path, part, number, n_docs, n_tokens and start (tokens of all shards before)."""
    spark = df.sparkSession
    folder = folder or shared_path(spark, "token-shards")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        part, tokens, ids, counts, held, number = None, [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal tokens, ids, counts, held, number
            uri = f"{folder}/{own_name('shard', number, '.wm')}"
            with opened(uri, "w") as out:
                save(out, np.concatenate(tokens), enc.levels, ids, np.cumsum(np.concatenate(counts)))
            row = pa.RecordBatch.from_pylist(
                [{"path": uri, "part": part, "number": number, "n_docs": len(ids), "n_tokens": held}], _MANIFEST)
            tokens, ids, counts, held, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            part = batch.column(2)[0].as_py() if part is None and len(batch) else part
            texts = batch.column(1).fill_null("")
            own, n = enc.encode(texts.to_pylist())
            tokens.append(_with_end(own, n, end_id))
            counts.append(n + 1)
            ids += batch.column(0).to_pylist()
            held += len(tokens[-1])
            if held >= shard_tokens:
                yield flush()
        if ids:
            yield flush()

    rows = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    rows = rows.select("id", "text", F.spark_partition_id().cast("long").alias("part"))
    found = written(rows.mapInArrow(shards, "path string, part long, number long, n_docs long, n_tokens long"),
                    "token-manifest")
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return (found.join(parts, "part")
            .withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("base"))


_MANIFEST = pa.schema([("path", pa.string()), ("part", pa.int64()), ("number", pa.int64()), ("n_docs", pa.int64()),
                       ("n_tokens", pa.int64())])


def read(manifest: DataFrame, id: str = "doc_id") -> DataFrame:
    """``(id, start, ids)`` of every document from the shard files; ids are
    little-endian unsigned 32-bit integers with the end id."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(uri, "r") as f:
                    matrix, ids, ends = load(f.read())
                tokens = matrix.all()
                starts = ends - np.diff(ends, prepend=0)
                for lo in range(0, len(ids), 500):
                    some = range(lo, min(lo + 500, len(ids)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[i] for i in some], pa.int64()), pa.array(starts[some.start:some.stop] + base),
                        pa.array([tokens[starts[i]:ends[i]].astype("<u4").tobytes() for i in some], pa.binary()),
                    ], [id, "start", "ids"])

    files = written(manifest.select("path", "start"), "token-files")
    return (files.repartition(max(1, min(files.count(), 20_000)))
            .mapInArrow(documents, f"`{id}` long, start long, ids binary"))
