"""Operator 10: near-duplicate groups with SetSketch registers.

A document's set is its distinct 5-word shingles (64-bit hashes).  Documents
whose sets have a Jaccard similarity of at least 0.75 are linked; a group is a
connected component, and the document with the smallest id stays.

1. ``sketched``: one pass over the texts gives set size, a 128-bit fingerprint
   of the set and ``BANDS * ROWS`` registers.  A register is an exponentially
   spaced, truncated minimum, ``clip(floor(1 - log_b(min -ln(1-u)/a)), 0, q+1)``;
   two sketches merge by the larger register (``merged``).
2. Equal sets are one *class*, told by size and fingerprint (a partial
   aggregation, so a third of all rows being copies is one row for each task);
   from here on only one representative of each class takes part.  An id with several
   sets is linked to the representatives of all of them (``_own``).
3. Bands of registers key buckets.  Every bucket links its members to its
   smallest one (the hub), so a bucket of k members gives k - 1 pairs.
4. Pairs are rated by the joint likelihood of both sketches and their known set
   sizes; those far below the threshold go (``MARGIN``, over four standard
   errors), the rest is verified on the full sets.  Each member is first held
   against its most similar hub; other pairs follow only if the two are still in
   different components.
5. The rest is exact: once hubs are done, a link can only be missing between
   members of different components of a bucket, one of them outside the bucket's
   largest.  A pair needs an intersection of p (n + m) / (1 + p); cells of the
   hash range (``CELLS`` bits) that only one of both occupies bound it from above by
   (n + m - cells) / 2, inside the join.  In a crowd of documents that share much,
   but too little, few pairs pass; nothing is capped or dropped.

At similarity 0.75 a band agrees with probability 0.75^4; all 32 miss a pair with
probability 5e-6, and less above.

Defined results: null and empty texts, and texts without words, have no
shingles and link with nothing; texts of fewer than five words are one shingle;
repeated rows share a class; several texts under one id are one node that links
by any of them, and have one component, empty texts included.  Rows with a null id take no part: ``component_id`` is null and
``kept`` true.  Clashing output names replace the input's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .common import is_empty, written
from .components import components

WORDS = 5
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate and largest register.
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2
#: Pairs rated below threshold - MARGIN are not verified.
MARGIN = 0.16
#: At most so many ids (8 bytes each) are broadcast; more are shuffled with the texts.
BROADCAST_IDS = 1_000_000
#: Cells of the hash range that bound an intersection from above.
CELLS = 2048

_rng = np.random.default_rng(textvec.SEED + 10)
_FACTOR = _rng.integers(1, 2**63, REGISTERS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, REGISTERS, dtype=np.int64).astype(np.uint64)
_BAND = _rng.integers(1, 2**63, ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = textvec.words(texts, textvec.SPACED)
    every = textvec.shingles(w.hash, k)
    out = []
    for lo, n in zip(w.first[:-1].tolist(), w.counts.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(every[lo:lo + n - k + 1]))
        elif n:
            out.append(textvec.mix(textvec.shingles(w.hash[lo:lo + n], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (one row a set; a row of zeros for an empty set)."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(full):
        return out
    size = np.array([len(sets[i]) for i in full])
    start = np.cumsum(size) - size
    items = np.concatenate([sets[i] for i in full])
    low = np.empty((REGISTERS, len(full)), np.uint64)
    for r in range(REGISTERS):
        np.minimum.reduceat(items * _FACTOR[r] + _ADD[r], start, out=low[r])
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    out[full] = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, LIMIT + 1).T.astype(np.uint16)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 120) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of sketch pairs with known set sizes."""
    more = (a > b).sum(1)[:, None]
    less = (a < b).sum(1)[:, None]
    same = REGISTERS - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, steps)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    fit = (more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny))
           + same * np.log(np.maximum(1 - up - down, tiny)))
    return j[np.arange(len(j)), fit.argmax(1)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def sketched(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n, fa, fb, regs)`` of each row with an id."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            regs = registers(sets)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                _signed(np.array([textvec.mix(s).sum() for s in sets], np.uint64)),
                _signed(np.array([textvec.mix(s ^ other).sum() for s in sets], np.uint64)),
                pa.array([r.tobytes() for r in regs], pa.binary()),
            ], ["id", "n", "fa", "fb", "regs"])

    rows = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.where("id is not null").mapInArrow(sketch, "id long, n long, fa long, fb long, regs binary")


@F.arrow_udf(T.ArrayType(T.LongType()))
def band_keys(regs: Iterator[pa.Array]) -> Iterator[pa.Array]:
    salt = textvec.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for arr in regs:
        r = np.frombuffer(b"".join(arr.to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        keys = textvec.mix((r * _BAND).sum(2) + salt).view(np.int64)
        yield pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))


@F.arrow_udf(T.DoubleType())
def rating(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for ra, rb, na, nb in batches:
        a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in (ra, rb))
        yield pa.array(similarity(a, b, np.asarray(na, np.float64), np.asarray(nb, np.float64)))


@F.arrow_udf(T.BinaryType())
def set_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for arr in batches:
        yield pa.array([s.tobytes() for s in shingle_sets(arr)], pa.binary())


@F.arrow_udf(T.LongType())
def common(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Size of the intersection of two sorted sets."""
    for sa, sb in batches:
        out = []
        for x, y in zip(sa, sb, strict=True):
            both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
            both.sort()
            out.append(int((both[1:] == both[:-1]).sum()))
        yield pa.array(out, pa.int64())


class _Links:
    """Labels of the representatives so far, and the verification of pairs."""

    def __init__(self, texts: DataFrame, reps: DataFrame, percent: int):
        self.texts, self.reps, self.percent = texts, reps, percent
        self.sets: list[DataFrame] = []
        self.labels: DataFrame | None = None

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components, with their labels la, lb."""
        for end in ("a", "b"):
            if self.labels is None:
                pairs = pairs.withColumn(f"l{end}", F.col(end))
            else:
                names = self.labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
                pairs = pairs.join(names, end, "left").withColumn(f"l{end}", F.coalesce(f"l{end}", end))
        return pairs.where("la != lb")

    def rated(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches may reach the threshold: a, b, na, nb, rating."""
        for end in ("b", "a"):
            pairs = pairs.join(self.reps.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"),
                                                F.col("regs").alias(f"r{end}")), end)
        small, large = F.least("na", "nb"), F.greatest("na", "nb")
        pairs = pairs.where(100 * small >= self.percent * large)
        pairs = pairs.withColumn("rating", rating("ra", "rb", "na", "nb"))
        return pairs.where(F.col("rating") >= self.percent / 100 - MARGIN).select("a", "b", "na", "nb", "rating")

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """(id, set) of at least these ids; sets are made once and kept as files."""
        for old in self.sets:
            ids = ids.join(old.select("id"), "id", "left_anti")
        ids = written(ids.distinct(), "dedup-need")
        if ids.count() <= BROADCAST_IDS:  # a checked size: the texts stay where they are
            ids = F.broadcast(ids)
        texts = self.texts.join(ids, "id", "left_semi")
        sets = texts.select("id", set_bytes("text").alias("set")).distinct()  # repeated rows are one set
        self.sets.append(written(sets, "dedup-sets"))
        sets = self.sets[0]
        for more in self.sets[1:]:
            sets = sets.union(more)
        return sets

    def join(self, pairs: DataFrame) -> None:
        """Verify the rated pairs on full sets and merge the components that they link."""
        if is_empty(pairs):
            return
        sets = self.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        full = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        full = full.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
        full = full.withColumn("both", common("sa", "sb"))
        # sizes of the sets themselves: an id may have several
        union = (F.octet_length("sa") + F.octet_length("sb")) / 8 - F.col("both")
        self.merge(written(full.where(100 * F.col("both") >= self.percent * union).select("a", "b"), "dedup-links"))

    def merge(self, links: DataFrame) -> None:
        """Merge the components that links (a, b) connect."""
        found = components(self.apart(links), "la", "lb")
        if self.labels is None:
            self.labels = written(found, "dedup-labels")
            return
        new = found.select(F.col("node").alias("label"), F.col("label").alias("to"))
        moved = (self.labels.join(new, "label", "left")
                 .select("node", F.coalesce("to", "label").alias("label")))
        known = self.labels.select("node")
        self.labels = written(moved.union(found.join(known, "node", "left_anti").select("node", "label")), "dedup-labels")


def _hubs(members: DataFrame, links: _Links) -> None:
    """Hold every member against the hubs of its buckets."""
    stars = members.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    rated = written(links.rated(links.apart(stars).select("a", "b")), "dedup-rated")
    best = rated.groupBy("b").agg(F.max(F.struct("rating", F.expr("-a").alias("a"))).alias("x"))
    best = best.select("b", F.expr("-x.a").alias("a"))
    links.join(rated.join(best, ["a", "b"]))
    rest = rated.join(best, ["a", "b"], "left_anti")
    links.join(written(links.apart(rest).select("a", "b", "na", "nb", "rating"), "dedup-rest"))


def _mixed(members: DataFrame, links: _Links) -> DataFrame:
    """Members of the buckets that hold several components: key, id, label and
    ``main`` (label of the bucket's largest component).  As in ``_members``, the
    aggregate is written first, so that AQE can split a crowded bucket."""
    if links.labels is None:
        named = members.select("key", "id", F.col("id").alias("label"))
    else:
        names = links.labels.select(F.col("node").alias("id"), "label")
        named = members.join(names, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    named = written(named, "dedup-named")
    parts = named.groupBy("key", "label").count()
    of_key = parts.groupBy("key").agg(
        F.count("*").alias("labels"), F.max(F.struct("count", F.expr("-label").alias("l"))).alias("top"))
    of_key = written(of_key.where("labels > 1").select("key", F.expr("-top.l").alias("main")), "dedup-several")
    return written(named.join(of_key, "key"), "dedup-mixed")


_CELLS = T.StructType([T.StructField("n", T.LongType()), *[T.StructField(f"c{i}", T.LongType()) for i in range(CELLS // 64)]])


@F.arrow_udf(_CELLS)
def cells(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Size of a set and which of ``CELLS`` cells of the hash range it occupies, as bits."""
    for arr in batches:
        bits = np.zeros((len(arr), CELLS), bool)
        size = []
        for k, x in enumerate(arr):
            own = np.frombuffer(x.as_buffer(), np.uint64)
            bits[k, (own % np.uint64(CELLS)).astype(np.int64)] = True
            size.append(len(own))
        longs = np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(len(arr), CELLS // 64)
        yield pa.StructArray.from_arrays(
            [pa.array(size, pa.int64()), *[pa.array(np.ascontiguousarray(longs[:, i])) for i in range(CELLS // 64)]],
            _CELLS.names)


def _rest(mixed: DataFrame, links: _Links) -> DataFrame:
    """Pairs (a, b) of different components of a bucket, one end outside its largest,
    whose intersection can be large enough."""
    sets = links.sets_of(mixed.select("id").distinct())
    known = written(sets.select("id", cells("set").alias("x")).select("id", "x.*").distinct(), "dedup-cells")
    names = [f"c{i}" for i in range(CELLS // 64)]
    one = mixed.where("label != main").join(known, "id").select("key", "id", "label", "n", *names)
    other = mixed.join(known, "id").select(
        "key", F.col("id").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"),
        *[F.col(c).alias(f"d{c[1:]}") for c in names])

    # cells that only one of both has: no more than the sets' symmetric difference
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"d{c[1:]}"))) for c in names), F.lit(0))
    p, both = links.percent, F.col("n") + F.col("nb")
    enough = (100 + p) * (both - differ) >= 2 * p * both
    pairs = one.join(other, (one["key"] == other["key"]) & (F.col("label") != F.col("lb")) & enough)
    return pairs.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()


def _members(keyed: DataFrame) -> DataFrame:
    """Rows (key, id) of the keys with several members, and the key's smallest member.
    The hubs are written before the rows are joined with them: an aggregate on the join
    key itself would keep a crowded bucket in one task."""
    hubs = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("hub")).where("size > 1")
    hubs = written(hubs.select("key", "hub"), "dedup-hubs")
    return written(keyed.join(hubs, "key"), "dedup-members")


def _own(sk: DataFrame, classes: DataFrame, set_key: list[str]) -> DataFrame:
    """(a, b): each id with several sets, and the representatives of their classes."""
    least = [F.min(c).alias(f"{c}_") for c in set_key]
    several = sk.groupBy("id").agg(*least, *[F.max(c).alias(c) for c in set_key])
    several = several.where(" OR ".join(f"{c} != {c}_" for c in set_key)).select("id")
    sets = sk.select("id", *set_key).join(several, "id", "left_semi").distinct()
    return sets.join(classes, set_key).where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` of each row of ``df``."""
    sk = written(sketched(df, id, text), "dedup-sketches")
    set_key = ["n", "fa", "fb"]
    classes = sk.where("n > 0").groupBy(*set_key).agg(F.min("id").alias("rep"))
    classes = written(classes, "dedup-classes")
    reps = sk.join(classes.withColumnRenamed("rep", "id"), [*set_key, "id"], "left_semi").select("id", "n", "regs")
    reps = written(reps.dropDuplicates(["id", "n", "regs"]), "dedup-reps")
    texts = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    links = _Links(texts.where("id is not null"), reps, percent)

    own = written(_own(sk, classes, set_key), "dedup-own")
    if not is_empty(own):
        links.merge(own)

    bands = reps.select("id", band_keys("regs").alias("keys"))
    members = _members(bands.select("id", F.explode("keys").alias("key")).distinct())
    if not is_empty(members):
        _hubs(members, links)
        mixed = _mixed(members, links)
        if not is_empty(mixed):
            links.join(written(links.rated(_rest(mixed, links)), "dedup-rated"))

    rows = sk.select("id", *set_key).join(classes, set_key, "left")
    rows = rows.withColumn("rep", F.coalesce("rep", "id"))  # an empty text goes with its id
    if links.labels is None:
        rows = rows.withColumn("label", F.lit(None).cast("long"))
    else:
        rows = rows.join(links.labels.withColumnRenamed("node", "rep"), "rep", "left")
    rows = rows.select(F.col("id").alias(id), F.col("n").alias("n_shingles"),
                       F.coalesce("label", "rep").alias("component_id"))
    rows = rows.withColumn("kept", F.col(id) == F.col("component_id"))
    nameless = texts.where("id is null").select(
        F.col("id").alias(id), (F.octet_length(set_bytes("text")) / 8).cast("long").alias("n_shingles"),
        F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return rows.union(nameless)
