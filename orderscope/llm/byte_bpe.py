"""Operator 8: byte-level BPE encoding and decoding with a two-tier lookup.

``encode(df, ...)`` adds the token ids of a text column as a binary column of
little-endian unsigned 32-bit integers; ``decode(df, ...)`` turns such a column
back into the bytes of the text.

Tier 1: a minimal perfect hash over the vocabulary (cascaded bit tables with
rank) finds pre-tokens that are vocabulary entries themselves; the entry found
is compared with the pre-token, so strangers never match.  Tier 2: a miss is
merged over a doubly linked list of its bytes with a heap of (rank, position),
lowest rank first, leftmost first among equals, so the work on a piece of n
bytes is O(n log n) however long it is.

The vocabulary (ranks of byte strings) is read from its file once per Python
worker; its size is fixed.  Texts are encoded whole, one by one on their own
row, so there is no shuffle and a lost executor repeats only its own rows.

Defined results: null texts are empty (no ids); an empty text has an empty id
list; repeated rows get equal rows; an output column of a name that the input
has replaces it, other columns pass unchanged; null id lists decode to no bytes.
Ids outside the vocabulary raise ``ValueError`` in ``decode``.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec

#: Pre-tokens whose ids a worker keeps; the rest is computed again.
MEMO_ENTRIES = 300_000
#: Text handled at a time inside a batch, in characters.
STEP_CHARS = 1 << 21


class MinimalPerfectHash:
    """Maps each of ``n`` distinct 64-bit keys to its own number below ``n``.

    Level by level the remaining keys are thrown at a bit table of about twice
    their number; keys alone on their bit stay, the others go on.  A key's
    number is the rank of its bit.  ``find`` gives -1 where every level's bit
    is unset; a stranger may get any number, so callers compare the entry.
    """

    def __init__(self, keys: np.ndarray, load: float = 2.0):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        self.tables: list[np.ndarray] = []
        self.before: list[int] = []
        done, rest, level = 0, keys, 0
        while len(rest):
            size = max(8, int(load * len(rest)))
            at = self._at(rest, level, size)
            seen = np.bincount(at, minlength=size)
            bits = seen == 1
            rank = np.where(bits, np.cumsum(bits) - 1, -1)
            self.tables.append(np.where(bits, rank + done, -1).astype(np.int32))
            done += int(bits.sum())
            rest = rest[~bits[at]]
            level += 1
        self.n = done

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        return (textvec.mix(keys + salt) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, table in enumerate(self.tables):
            if not len(open_):
                break
            got = table[self._at(keys[open_], level, len(table))]
            out[open_] = got
            open_ = open_[got < 0]
        return out


def _hashes(pieces: list[bytes]) -> np.ndarray:
    """Case-sensitive 64-bit hash of each piece: its folded word hash and the
    places of its capitals, told apart by a second pass over the bytes."""
    out = np.zeros(len(pieces), np.uint64)
    if not pieces:
        return out
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    end = np.cumsum(size)
    start = end - size
    place = np.arange(len(buf)) - np.repeat(start, size)
    each = textvec.mix(textvec._VALUE[buf] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
    return textvec.mix(total[end] - total[start] + size.astype(np.uint64))


class Vocabulary:
    """Ranks of byte strings from a tiktoken file, with both lookup tiers."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.pattern = regex.compile(pattern)
        words = list(self.ranks)
        keys = _hashes(words)
        self.hash = MinimalPerfectHash(keys)
        place = self.hash.find(keys)
        self.entry: list[bytes] = [b""] * self.hash.n
        self.entry_id: list[bytes] = [b""] * self.hash.n
        for at, word in zip(place.tolist(), words, strict=True):
            self.entry[at] = word
            self.entry_id[at] = array("I", [self.ranks[word]]).tobytes()
        top = max(self.ranks.values(), default=-1) + 1
        size = np.full(top, -1, np.int64)
        by_id = [b""] * top
        for word, rank in self.ranks.items():
            by_id[rank] = word
            size[rank] = len(word)
        self.size = size
        self.start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.memo: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Tier 2: merge the linked bytes of one piece, lowest rank first."""
        rank, n = self.ranks.get, len(piece)
        if n < 2:
            return [self.ranks[piece]] if n else []
        end = list(range(1, n + 2))      # part at i covers piece[i:end[i]]; -1: merged away
        left = list(range(-1, n))        # part before the one at i
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, mid, stop = heappop(heap)
            if end[i] != mid or end[mid] != stop:
                continue  # one of the two parts has changed since
            end[mid] = -1
            end[i] = stop
            if stop < n:
                left[stop] = i
                s = end[stop]
                if (r := rank(piece[i:s])) is not None:
                    heappush(heap, (r, i, stop, s))
            j = left[i]
            if j >= 0 and (r := rank(piece[j:stop])) is not None:
                heappush(heap, (r, j, i, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def pieces(self, tokens: list[str]) -> list[bytes]:
        """Ids (32-bit, native order) of each distinct pre-token: memo, then tier 1, then tier 2."""
        memo = self.memo
        new = [t for t in tokens if t not in memo]
        if new:
            if len(memo) + len(new) > MEMO_ENTRIES:
                memo.clear()
                new = tokens
            raw = [t.encode() for t in new]
            at = self.hash.find(_hashes(raw))
            entry = self.entry
            for token, word, k in zip(new, raw, at.tolist(), strict=True):
                if k >= 0 and entry[k] == word:
                    memo[token] = self.entry_id[k]
                else:
                    memo[token] = array("I", self.merged(word)).tobytes()
        return [memo[t] for t in tokens]

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [self.pattern.findall(t) for t in texts]
        count = np.fromiter(map(len, found), np.int64, len(found))
        number: dict[str, int] = {}
        code = np.array([number.setdefault(t, len(number)) for t in chain.from_iterable(found)], np.int64)
        ids = self.pieces(list(number))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, lens = _gather(np.frombuffer(b"".join(ids), np.uint32), np.cumsum(size) - size, size, code)
        edge = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(count)])]
        raw = flat.astype("<u4").tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (int(ids.max()) >= len(self.size) or (self.size[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        return _gather(self.bytes, self.start, np.maximum(self.size, 0), ids)[0].tobytes()


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, code: np.ndarray):
    """The runs ``flat[start[c]:start[c]+size[c]]`` of each code, joined; and their sizes."""
    lens = size[code]
    ends = np.cumsum(lens)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[code] - (ends - lens), lens)
    return flat[at], lens


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary per worker process and file."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary(path, pattern)
    return _LOADED[path, pattern]


def _steps(texts: list[str | None]) -> Iterator[list[str]]:
    step, size = [], 0
    for t in texts:
        step.append(t or "")
        size += len(step[-1])
        if size >= STEP_CHARS:
            yield step
            step, size = [], 0
    if step:
        yield step


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the ids of each whole text, as little-endian unsigned 32-bit integers."""

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path, pattern)
        for arr in batches:
            yield pa.array([x for s in _steps(arr.to_pylist()) for x in v.encode(s)], pa.binary())

    return df.withColumn(out, F.arrow_udf(ids, "binary")(F.col(f"`{text}`")))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that the ids stand for."""

    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path, pattern)
        for arr in batches:
            yield pa.array([v.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in arr], pa.binary())

    return df.withColumn(out, F.arrow_udf(raw, "binary")(F.col(f"`{ids}`")))
