"""Operator 12: toxicity by a factorization machine over hashed terms.

    score = sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>)

over the distinct active terms i of a text.  The second sum, taken as half of
(sum v)^2 - sum v^2, is linear in the terms; it learns pairs, such as an insult with
the mention of a group, that the weights w alone cannot tell from either one.

Terms of a text are its words and the first ``PREFIXES`` bytes of longer words (forms of
one stem meet there), hashed to ``SLOTS`` slots; each slot counts once in a text, so
neither length nor repetition dilutes a term.  The ``ACTIVE`` slots with the highest
chi-square against the label enter the model, all others are never looked at again.

Labels are learnt from rows that are not held out, at most about ``TOXIC`` toxic and
``OTHER`` other ids (documented bounds; chosen by a hash of the id, so spread over the
table and independent of its layout), weighted back to their shares among all
such labels.  Equal texts of one label are one example.  Their slots are written
to the shared folder, counted there by Spark, and only active slots reach the driver.
Scoring covers every row, whole texts, without a shuffle.  Ids, languages, sources
and labels are never terms.

Defined results: null, empty and wordless texts have no terms and the fixed score
sigmoid(b); repeated rows get equal scores; rows without an id or a label are never
learnt from, an id that is labelled both ways is learnt from as both; without an
example of either label every score is 0.5.  An output column that the input has is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .common import tune, written

TOXIC, OTHER = 3_000, 5_000
SLOTS_BITS = 20
SLOTS = 1 << SLOTS_BITS
ACTIVE = 1_024
FACTORS = 4
PREFIXES = (3, 4, 5)
#: Texts with this score or more are toxic.
LIMIT = 0.7


def slots(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every occurrence of a term in a batch of texts."""
    w = textvec.words(arr, textvec.ALNUM)
    text = w.texts()
    hashes, texts = [w.hash], [text]
    size = w.end - w.start
    for k in PREFIXES:
        of = np.flatnonzero(size > k)
        key = np.full(len(of), k, np.uint64)
        for j in range(k):
            key = key << np.uint64(8) | textvec.FOLD[w.buf[w.start[of] + j]].astype(np.uint64)
        hashes.append(textvec.mix(key))
        texts.append(text[of])
    slot = (np.concatenate(hashes) >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)
    return np.concatenate(texts), slot


@dataclass
class Model:
    active: np.ndarray  # slots in order
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def terms(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, index) of the active slots of each text, each once."""
        text, slot = slots(arr)
        if not len(self.active) or not len(slot):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.active, slot), len(self.active) - 1)
        here = self.active[at] == slot
        code = np.unique(text[here] * len(self.active) + at[here])
        return code // len(self.active), code % len(self.active)

    def score(self, arr: pa.Array) -> np.ndarray:
        text, term = self.terms(arr)
        total = lambda x: np.bincount(text, weights=x, minlength=len(arr))
        z = self.bias + total(self.weights[term])
        for v in self.factors.T:
            z += (total(v[term]) ** 2 - total(v[term] ** 2)) / 2
        return 1 / (1 + np.exp(-z.clip(-50, 50)))


def margins(x: np.ndarray, w: np.ndarray, v: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    """The machine's margin for rows of 0 and 1, and the sums of factors it rests on."""
    s = x @ v
    return b + x @ w + (s * s - x @ (v * v)).sum(1) / 2, s


def loss(x, y, weight, w, v, b, decay) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Weighted logistic loss with weight decay, and its gradients."""
    z, s = margins(x, w, v, b)
    value = (weight * np.logaddexp(0, np.where(y, -z, z))).sum() + decay / 2 * ((w * w).sum() + (v * v).sum())
    g = weight * (1 / (1 + np.exp(-z.clip(-50, 50))) - y)
    xg = x.T @ g
    return value, xg + decay * w, x.T @ (g[:, None] * s) - v * xg[:, None] + decay * v, g.sum()


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, rate: float = 0.05,
          decay: float = 5e-6, seed: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """Adam on full batches; ``weight`` adds up to 1."""
    rng = np.random.default_rng(seed)
    x, y, weight = x.astype(np.float32), y.astype(np.float32), weight.astype(np.float32)
    p = [np.zeros(x.shape[1], np.float32), rng.normal(0, 0.01, (x.shape[1], FACTORS)).astype(np.float32), np.zeros(1, np.float32)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        _, *grads = loss(x, y, weight, p[0], p[1], p[2][0], decay)
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return p[0], p[1], float(p[2][0])


def held_out(id: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(f"`{id}`").cast("string")) % 3 == 1, F.lit(False))


def _some(ids: DataFrame, total: int, most: int) -> DataFrame:
    """About ``most`` of ``total`` distinct ids, by a hash of the id."""
    share = min(1.0, most / max(1, total))
    chosen = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1_000_000)) < int(1_000_000 * share) + (share == 1.0)
    return ids.where(chosen).limit(2 * most)


def fit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
        toxic: int = TOXIC, other: int = OTHER) -> Model:
    """Learn from labels that are not held out."""
    tune(df.sparkSession)
    known = labels.where(F.col(f"`{label}`").isin(0, 1) & ~held_out(id) & F.col(f"`{id}`").isNotNull())
    known = known.select(F.col(f"`{id}`").alias("id"), (F.col(f"`{label}`") == 1).alias("toxic")).distinct()
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), 0.0)
    some = _some(known.where("toxic"), total[True], toxic).union(_some(known.where("not toxic"), total[False], other))
    texts = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    texts = texts.join(F.broadcast(some), "id")  # at most 2 * (toxic + other) ids

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, slot = slots(b.column(0))
            code = np.unique(row * SLOTS + slot)
            ends = np.searchsorted(code, np.arange(1, b.num_rows + 1) * SLOTS)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array((code % SLOTS).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(1), lists], ["toxic", "slots"])

    seen = texts.select("text", "toxic").mapInArrow(examples, "toxic boolean, slots array<int>")
    seen = written(seen.groupBy("toxic", "slots").agg(F.count("*").alias("rows")).withColumn("id", F.xxhash64("toxic", "slots")), "examples")
    size = {r["toxic"]: r["count"] for r in seen.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), 0.0)
    n1, n0 = float(size[True]), float(size[False])
    count = seen.select("toxic", F.explode("slots").alias("slot")).groupBy("slot").agg(
        F.count_if("toxic").cast("double").alias("a"), F.count_if(~F.col("toxic")).cast("double").alias("c"))
    off = F.col("a") * (n0 - F.col("c")) - F.col("c") * (n1 - F.col("a"))
    rest = (F.col("a") + F.col("c")) * (n1 + n0 - F.col("a") - F.col("c"))
    best = count.where(F.col("a") + F.col("c") >= 2).orderBy(F.desc(off * off / F.greatest(rest, F.lit(1.0))), "slot").limit(ACTIVE)
    active = np.sort(np.array([r["slot"] for r in best.select("slot").collect()], np.int64))
    got = seen.select("id", "toxic", F.explode_outer(F.array_intersect("slots", F.array(*map(F.lit, active.tolist())).cast("array<int>"))).alias("slot"))
    got = got.toArrow().sort_by([("id", "ascending"), ("slot", "ascending")])
    ids, row = np.unique(got["id"].to_numpy(), return_inverse=True)
    y = np.zeros(len(ids), bool)
    y[row] = got["toxic"].to_numpy(zero_copy_only=False)
    slot = got["slot"].to_numpy(zero_copy_only=False)
    has = ~np.isnan(slot.astype(float))
    x = np.zeros((len(ids), len(active)), np.float32)
    x[row[has], np.searchsorted(active, slot[has].astype(np.int64))] = 1
    share = total[True] / (total[True] + total[False])
    weight = np.where(y, share / n1, (1 - share) / n0)
    return Model(active, *train(x, y, weight))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: how likely label 1 is, from 0 to 1."""

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array(model.score(arr))

    return df.withColumn(out, F.arrow_udf(scores, T.DoubleType())(F.col(f"`{text}`").cast("string")))
