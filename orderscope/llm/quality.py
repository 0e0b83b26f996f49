"""Operator 2: quality by positive-unlabelled learning.

``fit`` minimises the non-negative unbiased risk of a linear model,

    pi E_P[l(f)] + max(0, E_U[l(-f)] - pi E_P[l(-f)]),  l the logistic loss,

on trusted positives P and unlabelled web text U; where the second part falls
below zero its gradient is turned round, as the non-negative estimator does.  The class
prior pi is estimated from P and U alone: the smallest ratio of the shares of U and
P above a score, over all scores, with its sampling error added before the
smallest is taken (best-bin estimate), on the halves that a first model was not
fitted to.

The trusted positives are a bounded sample of the labelled rows (``POSITIVES``); the
unlabelled side is every row that is not held out.  A sample of it (``SAMPLE``) only
gives the curvature: the prior rests on the histogram of all unlabelled scores, and the
risk that is minimised has the value and the gradient of the whole table's.  In each of
``ROUNDS`` passes Spark adds up the unlabelled risk and its gradient at the present
weights over all rows, and the descent goes on over the sample's risk plus the linear
term that makes its gradient there the whole table's.  Both samples are chosen by a
hash of the id, so they are spread over the table and do not depend on its layout.
Scoring covers every row, whole texts, without a shuffle.

Features of a text: square roots of the shares of pairs of adjacent byte classes
and of hashed words, and shares of repeated and distinct words, lengths of words
and lines.  Ids, languages, sources and labels are never features.

Defined results: null and empty texts have all features 0 and so one fixed
score; repeated rows get equal scores; rows without an id or a label are never
trusted; without any positive every score is the prior 0.5.  An output column
that the input has is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec

POSITIVES, SAMPLE = 6_000, 12_000
ROUNDS = 2
#: Bins of scores for the class prior.
BINS = 4_096
WORD_BUCKETS = 256
#: Texts with this score or more are accepted.
ACCEPT = 0.7

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",",
            b"!?", b"|", b"#*$%&", b"<>{}[]\\^~_=+@/", b"'\"`", b":;()-", bytes(range(0xC0, 0x100)),
            bytes(range(0x80, 0xC0))]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _k
N_CLASS = len(_CLASSES) + 1
WIDTH = N_CLASS * N_CLASS + WORD_BUCKETS + 6


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    return count / np.maximum(total, 1)


def features(arr: pa.Array) -> np.ndarray:
    """One row of ``WIDTH`` features a text."""
    w = textvec.words(arr, textvec.SPACED)
    n, counts, size = len(w.off) - 1, w.counts, np.diff(w.off)
    out = np.zeros((n, WIDTH), np.float32)
    if not n:
        return out
    pairs = N_CLASS * N_CLASS
    cls = _CLASS[w.buf].astype(np.int32)
    code = cls[:-1] * N_CLASS + cls[1:]
    for i, (a, b) in enumerate(zip(w.off[:-1].tolist(), w.off[1:].tolist(), strict=True)):
        if b - a > 1:
            out[i, :pairs] = np.bincount(code[a:b - 1], minlength=pairs)
    out[:, :pairs] = np.sqrt(out[:, :pairs] / np.maximum(size - 1, 1)[:, None])
    text = w.texts()
    bucket = (w.hash >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
    words = np.bincount(text * WORD_BUCKETS + bucket, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
    out[:, pairs:pairs + WORD_BUCKETS] = np.sqrt(words / np.maximum(counts, 1)[:, None])
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1])
    distinct = np.array([len(np.unique(w.hash[a:b])) for a, b in zip(w.first[:-1], w.first[1:], strict=True)])
    lines = np.bincount(np.searchsorted(w.off, np.flatnonzero(w.buf == 10), "right") - 1, minlength=n)[:n] + 1
    rest = out[:, pairs + WORD_BUCKETS:]
    rest[:, 0] = _share(np.bincount(text[again], minlength=n), counts)
    rest[:, 1] = _share(distinct, counts)
    rest[:, 2] = np.log1p(_share(size, counts))
    rest[:, 3] = np.log1p(_share(counts, lines))
    rest[:, 4] = np.log1p(counts)
    rest[:, 5] = counts > 0
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-z.astype(np.float64).clip(-50, 50)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, decay: float, tilt: tuple | None = None):
    """(positive part, negative part before it is cut at 0, gradients of both) of the risk at
    ``w``; ``tilt`` (value, gradient, at) corrects the unlabelled term from that of the
    rows ``u`` to that of all rows, to first order around ``at``."""
    zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    gp, gn, gu = -_sigmoid(-zp), _sigmoid(zp), _sigmoid(zu)  # d l(z), d l(-z) on P, d l(-z) on U
    grad = lambda x, g: np.append(x.T @ (g / len(x)), g.mean())
    first, negative = prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    up, down = prior * grad(p, gp), grad(u, gu) - prior * grad(p, gn)
    if tilt is not None:
        value, slope, at = tilt
        negative, down = negative + value + slope @ (w - at), down + slope
    return first + decay / 2 * (w[:-1] @ w[:-1]), negative, up + decay * np.append(w[:-1], 0), down


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int, rate: float, decay: float, tilt: tuple | None = None):
    """Adam on the non-negative risk (full batches)."""
    w = np.zeros(p.shape[1] + 1, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, negative, up, down = risk(w, p, u, prior, decay, tilt)
        g = (up + down if negative >= 0 else decay * np.append(w[:-1], 0) - down).astype(np.float32)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def best_bin(sp: np.ndarray, su: np.ndarray, nu: np.ndarray | None = None, delta: float = 0.1) -> float:
    """Share of positives in U from the scores of held-back P and U (``nu``: how often each
    score of U stands)."""
    nu = np.ones(len(su), np.int64) if nu is None else nu
    order = np.argsort(su)
    su, below = su[order], np.append(0, np.cumsum(nu[order]))
    at = np.sort(np.concatenate([sp, su]))
    qp = 1 - np.searchsorted(np.sort(sp), at, "left") / len(sp)
    qu = 1 - below[np.searchsorted(su, at, "left")] / below[-1]
    err = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(below[-1]))
    ok = qp > 0
    best = np.argmin((qu[ok] + err) / qp[ok])
    return float(np.clip(qu[ok][best] / qp[ok][best], 0.02, 0.98))


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    out = x - mean
    out /= scale
    return np.clip(out, -8, 8, out=out).astype(np.float32, copy=False)


def train(positive: np.ndarray, unlabelled: np.ndarray, every=None, steps: int = 250, rate: float = 0.03,
          decay: float = 2e-3) -> Model:
    """The model from features of trusted positives and of unlabelled texts; the
    weight decay grows as the positives get few.  ``every`` gives what all unlabelled
    rows say of a model, where ``unlabelled`` is a sample of them: ``every.scores`` the
    histogram of their held-back half, ``every.terms`` the mean unlabelled risk and its gradient."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.5)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), np.maximum(both.std(0), 1e-3)
    del both  # the driver's memory is small
    p, u = (_scaled(x, mean, scale) for x in (positive, unlabelled))
    model = lambda w: Model(mean, scale, w[:-1], float(w[-1]), prior)
    prior, decay = 0.5, decay + 6 / len(p)
    if len(p) >= 4 and len(u) >= 4:
        first = _descend(p[::2], u[::2], 0.5, steps // 2, rate, decay)
        if every is None:
            prior = best_bin(p[1::2] @ first[:-1], u[1::2] @ first[:-1])
        else:
            bins, n = every.scores(model(first))
            prior = best_bin(_bins(model(first).score(positive[1::2])), bins, n) if n.sum() else 0.5
    w = _descend(p, u, prior, steps, rate, decay)
    for _ in range(ROUNDS if every is not None else 0):
        n, value, slope = every.terms(model(w))
        z = u @ w[:-1] + w[-1]
        g = _sigmoid(z)
        here = np.append(u.T @ (g / len(u)), g.mean())
        w = _descend(p, u, prior, steps, rate, decay, (value - np.logaddexp(0, z).mean(), slope - here, w)) if n else w
    return model(w)


def _bins(scores: np.ndarray) -> np.ndarray:
    return np.minimum((scores * BINS).astype(np.int64), BINS - 1)


class Every:
    """What all unlabelled rows (id, text) say of a model, as Spark aggregations of a fixed size."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def scores(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """(bin, rows) of the scores of every second row by a hash of its id."""
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(BINS, np.int64)
            for b in batches:
                total += np.bincount(_bins(model.score(features(b.column(0)))), minlength=BINS)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["bin", "n"])

        half = self.rows.where(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(2)) == 1).select("text")
        got = half.mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
        return got["bin"].to_numpy(), got["n"].to_numpy()

    def terms(self, model: Model) -> tuple[int, float, np.ndarray]:
        """(rows, mean of l(-f), its gradient)."""
        size = len(model.weights) + 1

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + 2)
            for b in batches:
                x = ((features(b.column(0)) - model.mean) / model.scale).clip(-8, 8)
                z = (x @ model.weights + model.bias).astype(np.float64)
                g = _sigmoid(z)
                total += np.concatenate([g @ x, [g.sum(), np.logaddexp(0, z).sum(), len(z)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array(total)], ["at", "v"])

        got = self.rows.select("text").mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        v = got.sort_by("at")["v"].to_numpy()
        n = int(v[-1]) if len(v) else 0
        return n, float(v[-2] / n) if n else 0.0, v[:-2] / n if n else v


def held_out(id: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(f"`{id}`").cast("string")) % 4 == 2, F.lit(False))


def _some(df: DataFrame, id: str, most: int) -> DataFrame:
    """About ``most`` distinct ids, chosen by a hash of the id."""
    ids = df.select(F.col(f"`{id}`").alias("id")).where("id is not null")
    share = min(1.0, most / max(1, ids.count()))
    some = ids.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * share) + (share == 1.0))
    return some.distinct().limit(2 * most)


def _gathered(got: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Features of the trusted rows and of the others, in an order that no layout changes."""
    got = got.sort_by([("id", "ascending"), ("x", "ascending")])
    mark = got["trusted"].combine_chunks()

    def part(rows: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(rows.to_pylist()), np.float32).reshape(-1, WIDTH)

    return part(got["x"].filter(mark)), part(got["x"].filter(pc.invert(mark)))


def fit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
        positives: int = POSITIVES, sample: int = SAMPLE) -> Model:
    """Fit to trusted positives (label 1, not held out) and all texts that are not held out."""
    trusted = labels.where((F.col(label) == 1) & ~held_out(id))
    p = _some(trusted, id, positives).withColumn("trusted", F.lit(True))
    u = _some(df.where(~held_out(id)), id, sample).withColumn("trusted", F.lit(False))
    texts = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    some = texts.join(F.broadcast(p.union(u)), "id")  # at most 2 * (positives + sample) ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [r.tobytes() for r in features(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary())], ["id", "trusted", "x"])

    kind = some.schema["id"].dataType.simpleString()
    some = some.select("id", "text", "trusted").mapInArrow(rows, f"id {kind}, trusted boolean, x binary")
    positive, unlabelled = _gathered(some.toArrow())
    return train(positive, unlabelled, Every(texts.where(~held_out("id") & F.col("id").isNotNull())))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: how likely label 1 is, from 0 to 1."""

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array(model.score(features(arr)))

    return df.withColumn(out, F.arrow_udf(scores, T.DoubleType())(F.col(f"`{text}`").cast("string")))
