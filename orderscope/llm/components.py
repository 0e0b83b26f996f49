"""Connected components of a link table by alternating large and small stars.

Every round is two partial aggregations and two joins over the remaining links,
written as Parquet in the shared folder; only two scalars (a count and a
checksum) reach the driver.  The aggregates are written before the links are joined
with them: so the joined side is no aggregate on the join key, and AQE can split the
partition of a hub with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _largest(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest one (``links``: written)."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links-low")
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _smallest(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest (``links``: written)."""
    low = written(links.groupBy("u").agg(F.min("v").alias("m")), "links-low")
    near = links.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` of every linked node but the labels themselves: ``label``
    is the smallest id that can be reached.  Links are undirected; self links,
    repeated links and links with a null end count for nothing."""
    now = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x != y").select("u", "v").distinct(), "links")
    seen = None
    while True:
        total = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if total == seen or not total["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = total
        now = written(_smallest(written(_largest(now), "links-large")), "links")
