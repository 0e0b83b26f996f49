"""K-means on the standardised RFM features.

* Starts are k-means++ draws over all customers.  The next centre is the customer with
  the least ``-ln(u) / d2``: ``d2`` is the squared distance to the nearest centre so
  far and ``u`` in (0, 1) comes from the MD5 of (customer, start, step), which is a draw
  with probability proportional to ``d2``.  A step is one aggregation for all
  starts together; the first k centres of a start are its start for k clusters.
* Lloyd's passes run for all starts of all k together.  A task assigns its batch of
  customers in every model that still moves (numpy on Arrow batches) and adds up exact
  integer features for each (model, cluster); only models * k rows leave it.
  Means come from integer sums.

So neither depends on partitions or task order, and SQL can repeat both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scalars import attach_row
from ..plans.store import stored
from . import segments as G

MAX_ITER = 300
TOL = 1e-4
INTS = [f"i_{c}" for c in G.FEATURES]


def points(rfm: DataFrame) -> tuple[DataFrame, list[tuple[float, float, float]]]:
    """The customers with integer and standardised features, written once for the passes
    over them, and (mean, std, scale) of each feature."""
    scaled = stored(attach_row(G.scaled_features(rfm), G.scaling_stats(rfm)), "points")
    cols = [f"{k}_{c}" for c in G.FEATURES for k in ("mean", "std")]
    one = scaled.select(*cols).first()
    scale = [(one[f"mean_{c}"], one[f"std_{c}"] or 1.0, G.SCALE[c]) for c in G.FEATURES] if one else []
    return scaled.drop(*cols), scale


def uniform(ids: list, start: int, step: int) -> np.ndarray:
    """A number in (0, 1) from each id, the start and the step: 52 bits of an MD5."""
    digests = b"".join(md5(f"{i}-{start}-{step}".encode(), usedforsecurity=False).digest() for i in ids)
    return ((np.frombuffer(digests, ">u8")[::2] >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _draws(found: dict[int, np.ndarray], step: int):
    """The customer with the least key among those of a task, for each start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for b in batches:
            x, ids = _columns(b, G.Z), b["customer_id"].to_pylist()
            for s, centres in found.items():
                key, at = uniform(ids, s, step), np.arange(len(ids))
                if step:
                    d = _nearest(centres, x)[1]
                    at = np.flatnonzero(d > 0)
                    key = -np.log(key[at]) / d[at]
                if len(at):
                    low = min((int(i) for i in at[key == key.min()]), key=lambda i: ids[i])
                    best[s] = min(best.get(s, (np.inf,)), (float(key.min()), ids[low], *map(float, x[:, low])))
        if best:
            cols = list(zip(*((s, *row) for s, row in best.items()), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *map(pa.array, cols[1:])], ["s", "key", "customer_id", *G.Z])
    return run


def start_sequences(scaled: DataFrame, n_init: int, most: int) -> list[list[tuple]]:
    """``n_init`` sequences of at most ``most`` k-means++ centres (fewer, where the
    customers have fewer distinct features)."""
    found: list[list[tuple]] = [[] for _ in range(n_init)]
    kind = scaled.schema["customer_id"].dataType.simpleString()
    kind = f"s int, key double, customer_id {kind}, " + ", ".join(f"{z} double" for z in G.Z)
    rows = scaled.select("customer_id", *G.Z)
    for step in range(most):
        now = {s: np.array(c, float).reshape(-1, 3) for s, c in enumerate(found) if c or not step}
        drawn = rows.mapInArrow(_draws(now, step), kind).groupBy("s").agg(F.min(F.struct("key", "customer_id", *G.Z)).alias("best"))
        for r in drawn.collect():  # a row for each start
            found[r["s"]].append(tuple(r["best"][z] for z in G.Z))
    return found


def _nearest(centres: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each column of ``x``; ties to the lower cluster."""
    d = [(centres[:, f][:, None] - x[f]) * (centres[:, f][:, None] - x[f]) for f in range(len(x))]
    d = d[0] + d[1] + d[2]
    best = d.argmin(0)
    return best, d[best, np.arange(d.shape[1])]


def _columns(b: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([b[c].to_numpy() for c in names])


def _sums(models: dict[int, np.ndarray]):
    """Rows and exact sums of the integer features for each (model, cluster) of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: np.zeros((len(c), 4), np.int64) for m, c in models.items()}
        for b in batches:
            x, i = _columns(b, G.Z), _columns(b, INTS).astype(np.int64)
            # doubles add integers exactly below 2^53: larger features go in halves
            parts = [(i, 0)] if np.abs(i).max(initial=0) < 2**53 // (len(i[0]) + 1) else [(i >> 24, 24), (i & 0xFFFFFF, 0)]
            parts = [([x.astype(np.float64) for x in half], shift) for half, shift in parts]
            for m, centres in models.items():
                best, k = _nearest(centres, x)[0], len(centres)
                total[m][:, 0] += np.bincount(best, minlength=k)
                for half, shift in parts:
                    for f, values in enumerate(half):
                        total[m][:, f + 1] += np.bincount(best, values, k).astype(np.int64) << shift
        rows = [(m, k, *t) for m, sums in total.items() for k, t in enumerate(sums.tolist()) if t[0]]
        if rows:
            kinds = [pa.int32(), pa.int32()] + [pa.int64()] * 4
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["m", "cluster", "n", *G.FEATURES])
    return run


def _costs(models: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = dict.fromkeys(models, 0.0)
        for b in batches:
            x = _columns(b, G.Z)
            for m, centres in models.items():
                cost[m] += float(_nearest(centres, x)[1].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(cost), pa.int32()), pa.array(list(cost.values()), pa.float64())], ["m", "cost"])
    return run


def lloyd(scaled: DataFrame, scale: list[tuple], starts: list[list[tuple]], max_iter: int = MAX_ITER, tol: float = TOL) -> list[tuple]:
    """(centroids, cost) of every start after Lloyd's iterations, all starts in the same passes.

    A model stops when its centres move by at most ``tol`` (summed squares) in a pass;
    its cost is then taken from its last centres.  A cluster without customers keeps
    its centre."""
    now = [np.array(s, float).reshape(-1, 3) for s in starts]
    rows = scaled.select(*G.Z, *INTS)
    moving = {m for m, c in enumerate(now) if len(c)}
    for _ in range(max_iter):
        if not moving:
            break
        kind = "m int, cluster int, n long, " + ", ".join(f"{c} long" for c in G.FEATURES)
        sums = rows.mapInArrow(_sums({m: now[m] for m in sorted(moving)}), kind)
        sums = sums.groupBy("m", "cluster").agg(*[F.sum(c).alias(c) for c in ("n", *G.FEATURES)])
        new = {m: now[m].copy() for m in moving}
        for r in sums.collect():  # a row for each model and cluster
            new[r["m"]][r["cluster"]] = [(r[c] / r["n"] / s - mean) / std
                                         for c, (mean, std, s) in zip(G.FEATURES, scale, strict=True)]
        for m, centres in new.items():
            if ((now[m] - centres) ** 2).sum() <= tol:
                moving.discard(m)
            now[m] = centres
    cost = dict.fromkeys(range(len(now)), 0.0)
    found = rows.mapInArrow(_costs({m: c for m, c in enumerate(now) if len(c)}), "m int, cost double")
    cost |= {r["m"]: r["cost"] for r in found.groupBy("m").agg(F.sum("cost").alias("cost")).collect()}
    return [([tuple(map(float, c)) for c in centres], cost[m]) for m, centres in enumerate(now)]


def best_models(scaled: DataFrame, scale: list[tuple], ks: Sequence[int], n_init: int) -> dict[int, tuple]:
    """The (centroids, cost) of the best start of each k (equal costs, to 6 places, go to
    the first), followed until its centres rest."""
    starts = start_sequences(scaled, n_init, max(ks))
    models = lloyd(scaled, scale, [s[:k] for k in ks for s in starts])
    best = [min(models[j * n_init:(j + 1) * n_init], key=lambda x: round(x[1], 6))[0] for j in range(len(ks))]
    return dict(zip(ks, lloyd(scaled, scale, best, tol=0.0), strict=True))


def centroid_frame(spark, centroids) -> DataFrame:
    rows = [(k, *c) for k, c in enumerate(centroids)]
    return spark.createDataFrame(rows, "cluster int, " + ", ".join(f"{z} double" for z in G.Z))


def _cluster_sums(models: dict[int, np.ndarray]):
    """n, sum of squared norms and sums of the features for each (model, cluster) of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: np.zeros((len(c), 5)) for m, c in models.items()}
        for b in batches:
            x = _columns(b, G.Z)
            values = [np.ones(x.shape[1]), x[0] * x[0] + x[1] * x[1] + x[2] * x[2], *x]
            for m, centres in models.items():
                best = _nearest(centres, x)[0]
                total[m] += np.stack([np.bincount(best, v, len(centres)) for v in values], 1)
        rows = [(m, k, *t) for m, sums in total.items() for k, t in enumerate(sums.tolist()) if t[0]]
        if rows:
            kinds = [pa.int32(), pa.int32()] + [pa.float64()] * 5
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["m", "cluster", "n", "p", *G.Z])
    return run


def _silhouettes(models: dict[int, np.ndarray], sums: dict[int, np.ndarray]):
    """The sum of a task's silhouettes in each model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(models, 0.0)
        for b in batches:
            x = _columns(b, G.Z)
            norm, at = x[0] * x[0] + x[1] * x[1] + x[2] * x[2], np.arange(x.shape[1])
            for m, centres in models.items():
                best, (n, p, *y) = _nearest(centres, x)[0], sums[m].T[:, :, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = norm + p / n - 2.0 * (x[0] * y[0] + x[1] * y[1] + x[2] * y[2]) / n
                d[n[:, 0] == 0] = np.inf  # clusters without customers
                own = n[best, 0]
                a = d[best, at] * own / np.maximum(own - 1, 1)
                d[best, at] = np.inf
                other = d.min(0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    total[m] += float(np.where((own == 1) | (a == other), 0.0, (other - a) / np.maximum(a, other)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64())], ["m", "s"])
    return run


def silhouettes(scaled: DataFrame, models: dict[int, list[tuple]]) -> dict[int, float | None]:
    """Mean silhouette of each model (name -> centroids) with squared Euclidean distances,
    linear in the data: the mean distance of a customer x to a cluster of n customers y is
    ``|x|^2 + sum |y|^2 / n - 2 x . sum y / n``.  A customer alone in its cluster counts 0;
    undefined (None) with fewer than two clusters.  Two passes for all models together."""
    centres = {m: np.array(c, float).reshape(-1, 3) for m, c in models.items()}
    rows = scaled.select(*G.Z)
    found = rows.mapInArrow(_cluster_sums(centres), "m int, cluster int, n double, p double, " + ", ".join(f"{z} double" for z in G.Z))
    sums = {m: np.zeros((len(c), 5)) for m, c in centres.items()}
    for r in found.groupBy("m", "cluster").agg(*[F.sum(c).alias(c) for c in ("n", "p", *G.Z)]).collect():  # models * k rows
        sums[r["m"]][r["cluster"]] = [r["n"], r["p"], *(r[z] for z in G.Z)]
    good = {m: c for m, c in centres.items() if (sums[m][:, 0] > 0).sum() > 1}
    out: dict[int, float | None] = dict.fromkeys(models)
    if good:
        total = rows.mapInArrow(_silhouettes(good, sums), "m int, s double").groupBy("m").agg(F.sum("s").alias("s"))
        out |= {r["m"]: r["s"] / float(sums[r["m"]][:, 0].sum()) for r in total.collect()}
    return out


def kmeans_sweep(rfm: DataFrame, ks: Sequence[int] = range(2, 9), n_init: int = 10) -> DataFrame:
    """H2 + H3: inertia and silhouette (squared Euclidean) per k from the best of ``n_init`` starts."""
    scaled, scale = points(rfm)
    best = best_models(scaled, scale, list(ks), n_init)
    rated = silhouettes(scaled, {k: centroids for k, (centroids, _) in best.items()})
    rows = [(int(k), float(cost), rated[k]) for k, (_, cost) in best.items()]
    return rfm.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def kmeans_assigned(rfm: DataFrame, k: int = 4, n_init: int = 10) -> DataFrame:
    """H4: ``rfm`` with its scaled features and the cluster of the best of ``n_init`` fits.

    Cluster ids are arbitrary, so segments are named from the cluster profiles
    (H7), never from ids.
    """
    scaled, scale = points(rfm)
    centroids, _ = best_models(scaled, scale, [k], n_init)[k]
    return G.assign_centroids(scaled, centroid_frame(rfm.sparkSession, centroids))


def kmeans_violations(assigned: DataFrame, slack: float = 1e-3) -> DataFrame:
    """One row: customers, those clearly nearer (by ``slack``) to another cluster's mean
    than to their own, and the number of clusters."""
    means = assigned.groupBy("cluster").agg(*[F.avg(z).alias(z) for z in G.Z])
    one = means.agg(F.collect_list(F.struct("cluster", *G.Z)).alias("_cs"))
    own = F.expr("filter(_cs, c -> c.cluster = cluster)[0]")
    d = sum(((own[z] - F.col(z)) * (own[z] - F.col(z)) for z in G.Z), F.lit(0.0))
    j = attach_row(assigned.select(*G.Z, "cluster"), one)
    return j.agg(F.count("*").alias("customers"), F.count_if(d > G.nearest("_cs")["d"] * (1 + slack) + slack).alias("not_nearest"),
                 F.countDistinct("cluster").alias("clusters"))
