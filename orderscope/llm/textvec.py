"""Word spans and 64-bit word hashes of a batch of UTF-8 texts, in numpy.

A word is a maximal run of *word bytes*.  Both word classes used here
(``[^\\x20\\x09-\\x0D]+`` and ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) treat every
byte of a multi-byte character alike, so they can be told on bytes.  The work is
a handful of array passes per batch; memory per pass is bounded by ``PIECE``
bytes of text (or by the longest word, if that is longer).

Word hashes are polynomial in random per-byte values with an odd random base
modulo 2^64, then mixed; shingle hashes combine word hashes with random odd
factors.  Both are fixed by ``SEED``, so all executors agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEED = 20_240_607
PIECE = 1 << 19
U64 = np.uint64

_rng = np.random.default_rng(SEED)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15  # odd
_FACTORS = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)

#: ASCII white space of ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and all non-ASCII bytes: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
ALNUM[0x41:0x5B] = True  # A-Z are lower-cased first

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
_FOLDED_VALUE = _VALUE[FOLD]

_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POW or len(_POW["up"]) < n:
        size = max(n, PIECE + 1)
        inv = pow(_BASE, -1, 2**64)
        for name, base in (("up", _BASE), ("down", inv)):
            p = np.full(size, U64(base), U64)
            p[0] = U64(1)
            _POW[name] = np.multiply.accumulate(p)
    return _POW["up"], _POW["down"]


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls count as empty texts."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64, len(arr) + 1, arr.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


class Words:
    """Words of a batch: ``start``/``end`` byte positions in ``buf``, ``hash``,
    and ``first`` (words before each text; length texts + 1)."""

    __slots__ = ("buf", "off", "start", "end", "hash", "first")

    def __init__(self, buf, off, start, end, hash_, first):
        self.buf, self.off, self.start, self.end, self.hash, self.first = buf, off, start, end, hash_, first

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.off) - 1), self.counts)


def words(arr: pa.Array, word_bytes: np.ndarray = SPACED) -> Words:
    """Words of each text, with A-Z folded to a-z in the hashes."""
    buf, off = buffers(arr)
    n = len(buf)
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    is_word = word_bytes[buf]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = False
        before[1:] = is_word[:-1]
        after[:-1] = is_word[1:]
        before[inner] = False
        after[inner - 1] = False
    start = np.flatnonzero(is_word & ~before)
    end = np.flatnonzero(is_word & ~after) + 1
    hashes = np.empty(len(start), U64)
    lo = 0
    while lo < len(start):  # pieces of whole words
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + PIECE, "right")))
        a, b = int(start[lo]), int(end[hi - 1])
        up, down = _powers(b - a + 1)
        total = np.empty(b - a + 1, U64)
        total[0] = 0
        np.cumsum(_FOLDED_VALUE[buf[a:b]] * up[: b - a], out=total[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        hashes[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))
        lo = hi
    return Words(buf, off, start, end, hashes, np.searchsorted(start, off))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words of one array of word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out += hashes[j:j + n] * _FACTORS[j]
    return mix(out)


def phrase(text: str, word_bytes: np.ndarray = ALNUM) -> np.ndarray:
    """Word hashes of one text."""
    return words(pa.array([text]), word_bytes).hash
