"""Bounds of the mean Euclidean silhouette without pairs of customers.

The customers of a cluster are summarised by cells of an ``EDGE``-wide grid (the outermost
cells are open, so there are at most ``(2 * LIMIT + 1)^3`` a cluster, whatever the
data): count n, mean and summed variance v.  For a customer x the distances to the
customers y of a cell have the bounds (Jensen, twice)::

    n |x - mean|  <=  sum |x - y|  <=  n sqrt(|x - mean|^2 + v)

so the mean distances a (own cluster) and b (nearest other one) have bounds too, and the
silhouette falls with a and rises with b.  One aggregation and one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments as G

EDGE, LIMIT = 0.25, 16
#: Distances of so many pairs of a customer and a cell are in memory at once.
PAIRS = 1 << 20


def cells(assigned: DataFrame) -> DataFrame:
    """n, mean and summed population variance of each (cluster, cell)."""
    at = [F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.col(z) / F.lit(EDGE)))).alias(f"c_{z}") for z in G.Z]
    v = sum((F.var_pop(z) for z in G.Z), F.lit(0.0))
    found = assigned.groupBy("cluster", *at).agg(F.count("*").alias("n"), *[F.avg(z).alias(z) for z in G.Z], v.alias("v"))
    return found.select("cluster", "n", *G.Z, "v")


def _value(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(a == b, 0.0, (b - a) / np.maximum(a, b))


def _bounds(summary: dict[int, np.ndarray]):
    """Sums of both bounds over a task's customers; ``summary``: cluster -> rows n, mean, v."""
    names = np.array(sorted(summary))
    size = np.array([summary[c][:, 0].sum() for c in names])
    step = max(1, PAIRS // max(len(s) for s in summary.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros(2)
        for b in batches:
            every = np.stack([b[z].to_numpy() for z in G.Z])
            clusters = np.searchsorted(names, b["cluster"].to_numpy())
            for start in range(0, every.shape[1], step):
                x, own = every[:, start:start + step, None], clusters[start:start + step]
                at, low, high = np.arange(len(own)), [], []
                for c in names:
                    n, *mean, v = summary[c].T
                    d = sum((x[f] - mean[f]) ** 2 for f in range(3))
                    low.append(np.sqrt(d) @ n)
                    high.append(np.sqrt(d + v) @ n)
                low, high = np.array(low), np.array(high)
                others = np.maximum(size[own] - 1, 1)
                a = low[own, at] / others, high[own, at] / others
                low, high = low / size[:, None], high / size[:, None]
                low[own, at] = high[own, at] = np.inf
                alone = size[own] == 1
                total += [np.where(alone, 0.0, _value(a[1], low.min(0))).sum(), np.where(alone, 0.0, _value(a[0], high.min(0))).sum()]
                rows += len(own)
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([total[0]]), pa.array([total[1]])], ["n", "low", "high"])
    return run


def silhouette_bounds(assigned: DataFrame) -> DataFrame:
    """One row: customers, clusters, and silhouette_low <= mean Euclidean silhouette <= silhouette_high.

    A customer alone in its cluster counts 0; both bounds are NULL with fewer than two clusters."""
    spark = assigned.sparkSession
    summary: dict[int, list] = {}
    for r in cells(assigned).collect():  # at most (2 * LIMIT + 1)^3 cells a cluster
        summary.setdefault(r["cluster"], []).append((r["n"], *(r[z] for z in G.Z), r["v"]))
    kind = "customers long, clusters long, silhouette_low double, silhouette_high double"
    if len(summary) < 2:
        return spark.createDataFrame([(sum(c[0] for s in summary.values() for c in s), len(summary), None, None)], kind)
    arrays = {c: np.array(sorted(rows), float) for c, rows in summary.items()}
    found = assigned.select("cluster", *G.Z).mapInArrow(_bounds(arrays), "n long, low double, high double")
    n = F.sum("n")
    return found.agg(n.alias("customers"), F.lit(len(summary)).cast("long").alias("clusters"),
                     (F.sum("low") / n).alias("silhouette_low"), (F.sum("high") / n).alias("silhouette_high"))
