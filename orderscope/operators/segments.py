"""Standardised RFM features and segment reports.

* H1 standardises with the population std (StandardScaler, ddof 0) from exact
  integer sums, so the features are the same bits on every engine.
* H2–H4, the k-means fits, are in :mod:`orderscope.operators.kmeans`.
* H5 assigns customers to given centroids: the k centroids (k rows, bounded
  by construction) travel as one broadcast array row, and the nearest one is
  picked row-locally with higher-order functions — no shuffle, no pairs.
* H6–H12 profile, label and summarise any cluster assignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import dec, exact_double, round_half_even
from ..plans.scalars import attach_row
from ..session import checkpoint_dir

FEATURES = ["recency", "frequency", "monetary"]
Z = [f"{c}_z" for c in FEATURES]
# Segment names and their display order, as the reference uses them.
SEGMENTS = ["Champions", "Loyal Customers", "At-Risk Customers", "Lost / Inactive"]
# Composite score weights (−recency + 30·frequency + 0.01·monetary).
W_RECENCY, W_FREQUENCY, W_MONETARY = -1.0, 30.0, 0.01


def with_int_features(rfm: DataFrame) -> DataFrame:
    """``rfm`` plus the features as exact integers: days, orders, cents."""
    return rfm.withColumns({"i_recency": F.col("recency").cast("bigint"), "i_frequency": F.col("frequency").cast("bigint"),
                            "i_monetary": F.rint(F.col("monetary") * 100.0).cast("bigint")})


SCALE = {"recency": 1.0, "frequency": 1.0, "monetary": 100.0}


def scaling_stats(rfm: DataFrame) -> DataFrame:
    """One row: ``mean_<c>`` and population ``std_<c>`` of each feature."""
    iv = with_int_features(rfm)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in FEATURES:
        aggs += [F.sum(f"i_{c}").alias(f"s_{c}"), F.sum(dec(f"i_{c}") * dec(f"i_{c}")).alias(f"ss_{c}")]
    st = iv.agg(*aggs)
    cols = []
    for c in FEATURES:
        n = F.nullif(F.col("n"), F.lit(0)).cast("double")  # no rows: no statistics
        mean = F.col(f"s_{c}").cast("double") / n / F.lit(SCALE[c])
        var = exact_double(dec("n") * F.col(f"ss_{c}") - dec(f"s_{c}") * dec(f"s_{c}")) / (n * n) \
            / F.lit(SCALE[c] * SCALE[c])
        cols += [mean.alias(f"mean_{c}"), F.sqrt(var).alias(f"std_{c}")]
    return st.select(*cols)


def _z(x, c: str):
    """The standardised value; a feature without variance is scaled by 1, as StandardScaler does."""
    std = F.col(f"std_{c}")
    return (x - F.col(f"mean_{c}")) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def scaled_features(rfm: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """``rfm`` with its integer features and their standardised values."""
    j = attach_row(with_int_features(rfm), scaling_stats(rfm) if stats is None else stats)
    return j.select(*rfm.columns, *[f"i_{c}" for c in FEATURES],
                    *[_z(F.col(f"i_{c}").cast("double") / F.lit(SCALE[c]), c).alias(f"{c}_z") for c in FEATURES])


def rfm_scaled(rfm: DataFrame) -> DataFrame:
    """H1: ``(x - mean) / std_pop`` for recency, frequency, monetary."""
    return scaled_features(rfm).select("customer_id", *Z)


def seed_centroids(scores: DataFrame) -> DataFrame:
    """Deterministic centroids for the checkable path: the mean scaled vector of
    four RFM-total bands (``least(3, (rfm_total - 3) div 3)``), computed as the
    standardised band means of the exact integer features.  ``scores`` holds the
    features, so one aggregation of it is enough."""
    band = F.least(F.lit(3), F.expr("(rfm_total - 3) div 3")).cast("int")
    g = with_int_features(scores).groupBy(band.alias("cluster")).agg(
        F.count(F.lit(1)).alias("nb"), *[F.sum(f"i_{c}").alias(f"b_{c}") for c in FEATURES])
    g = attach_row(g, scaling_stats(scores))
    nb = F.col("nb").cast("double")
    return g.select("cluster", *[_z(F.col(f"b_{c}").cast("double") / nb / F.lit(SCALE[c]), c).alias(f"{c}_z")
                                 for c in FEATURES])


def nearest(centroids: str) -> Column:
    """(d, cluster) of the nearest centroid in an array column; ties to the lower id."""
    d = "+".join(f"(c.{z} - {z}) * (c.{z} - {z})" for z in Z)
    return F.expr(f"array_min(transform({centroids}, c -> named_struct('d', {d}, 'cluster', c.cluster)))")


def assign_centroids(scaled: DataFrame, centroids: DataFrame) -> DataFrame:
    """H5: ``scaled`` with the nearest centroid (squared Euclidean; ties to the lower id)."""
    one = centroids.agg(F.collect_list(F.struct("cluster", *Z)).alias("_cs"))  # k rows -> one row
    j = attach_row(scaled, one)
    return j.select(*scaled.columns, nearest("_cs")["cluster"].alias("cluster"))


def assigned_by_seeds(scores: DataFrame) -> DataFrame:
    """The scored customers with features and the cluster of the seed centroids, written
    once: profiles, labels and summaries are aggregations of this table."""
    checkpoint_dir(scores.sparkSession)
    return assign_centroids(scaled_features(scores), seed_centroids(scores)).checkpoint(eager=True)


def cluster_profile(assigned: DataFrame) -> DataFrame:
    """H6: mean recency / frequency / monetary per cluster and the composite score."""
    p = with_int_features(assigned).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("i_recency").alias("sr"), F.sum("i_frequency").alias("sf"),
        F.sum("i_monetary").alias("sm"))
    n = F.col("customers").cast("double")
    p = p.select("cluster", "customers", (F.col("sr").cast("double") / n).alias("recency"),
                 (F.col("sf").cast("double") / n).alias("frequency"),
                 (F.col("sm").cast("double") / n / F.lit(100.0)).alias("monetary"))
    comp = F.lit(W_RECENCY) * F.col("recency") + F.col("frequency") * F.lit(W_FREQUENCY) \
        + F.col("monetary") * F.lit(W_MONETARY)
    return p.withColumn("composite", comp)


def segment_labels(profile: DataFrame) -> DataFrame:
    """H7: label clusters by composite rank (highest: Champions, 2nd: Loyal,
    2nd lowest: At-Risk, lowest: Lost / Inactive); ties by cluster id."""
    k = F.count(F.lit(1)).over(Window.partitionBy())  # over the k profile rows only
    asc = F.row_number().over(Window.orderBy("composite", "cluster"))
    p = profile.select("cluster", "composite", asc.alias("rank"), k.alias("k"))
    seg = F.when(F.col("rank") == F.col("k"), SEGMENTS[0]) \
           .when(F.col("rank") == F.col("k") - 1, SEGMENTS[1]) \
           .when(F.col("rank") == 1, SEGMENTS[3]) \
           .when(F.col("rank") == 2, SEGMENTS[2])
    return p.select("cluster", "composite", "rank", seg.alias("segment"))


def customer_segments(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """H8: segment name per customer (labels: one row per cluster, k rows)."""
    return clusters.select("customer_id", "cluster").join(
        F.broadcast(labels.select("cluster", "segment")), "cluster").select("customer_id", "cluster", "segment")


def segmented(assigned: DataFrame) -> DataFrame:
    """The assigned customers with their segment: a join with the k labels, none by customer."""
    labels = segment_labels(cluster_profile(assigned))
    return assigned.join(F.broadcast(labels.select("cluster", "segment")), "cluster")


def segment_summary(seg: DataFrame, digits: int = 1) -> DataFrame:
    """Customers, mean R/F/M, total revenue and revenue share per segment.

    Share from the unrounded totals, then everything rounded (dashboard order, S27).
    """
    iv = seg.select("segment", F.col("recency").cast("bigint").alias("r"), F.col("frequency").cast("bigint").alias("f"),
                    F.rint(F.col("monetary") * 100.0).cast("bigint").alias("c"))
    g = iv.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"), F.sum("r").alias("sr"),
                                  F.sum("f").alias("sf"), F.sum("c").alias("sc"))
    n = F.col("customers").cast("double")
    tot = F.sum("sc").over(Window.partitionBy())  # over the segment rows only
    r = lambda e, name: round_half_even(e, digits).alias(name)
    return g.select("segment", "customers",
                    r(F.col("sr").cast("double") / n, "avg_recency"),
                    r(F.col("sf").cast("double") / n, "avg_frequency"),
                    r(F.col("sc").cast("double") / n / F.lit(100.0), "avg_monetary"),
                    r(F.col("sc").cast("double") / F.lit(100.0), "total_revenue"),
                    r(F.col("sc").cast("double") / tot.cast("double") * F.lit(100.0), "revenue_share"))


def segment_treemap(seg: DataFrame) -> DataFrame:
    """The treemap feed — customers, total, mean LTV and mean orders per
    segment (unrounded, from exact sums)."""
    g = seg.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"),
                                   F.sum(F.rint(F.col("monetary") * 100.0).cast("bigint")).alias("sc"),
                                   F.sum(F.col("frequency").cast("bigint")).alias("sf"))
    n = F.col("customers").cast("double")
    return g.select("segment", "customers", (F.col("sc").cast("double") / F.lit(100.0)).alias("total"),
                    (F.col("sc").cast("double") / n / F.lit(100.0)).alias("avg_ltv"),
                    (F.col("sf").cast("double") / n).alias("avg_freq"))


def _order() -> DataFrame:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(s, i + 1) for i, s in enumerate(SEGMENTS)], "segment string, seg_order int")


def segment_counts(seg: DataFrame) -> DataFrame:
    """Customers and % per segment, in the fixed segment order."""
    g = seg.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))
    tot = F.sum("customers").over(Window.partitionBy())
    g = g.select("segment", "customers",
                 (F.col("customers").cast("double") / tot.cast("double") * F.lit(100.0)).alias("pct"))
    return _order().join(F.broadcast(g), "segment", "left")  # g: at most 4 rows


def segment_revenue(seg: DataFrame) -> DataFrame:
    """Revenue per segment in the fixed order."""
    g = seg.groupBy("segment").agg(F.sum(F.rint(F.col("monetary") * 100.0).cast("bigint")).alias("c"))
    g = g.select("segment", (F.col("c").cast("double") / F.lit(100.0)).alias("revenue"))
    return _order().join(F.broadcast(g), "segment", "left")


def segment_customers(seg: DataFrame, segment: str | None = None) -> DataFrame:
    """The scatter feed, optionally one segment (the dashboard filter)."""
    s = seg if segment in (None, "All") else seg.where(F.col("segment") == F.lit(segment))
    return s.select("customer_id", "frequency", "monetary", "recency", "segment")
