"""Cohort retention.

Plan: one aggregation keyed by customer collects the set of months the
customer bought in.  The set is bounded by the calendar span of the data (one
entry per month, whatever the number of orders), and it is merged map-side,
so a customer holding a third of all orders is one short set per task before
the shuffle.  The cohort month is the set's minimum; exploding the set gives
every active (customer, month) with its age, already on the customer's
partition, so there is no second shuffle and no join back.  Distinct customers
per (cohort, age) are then plain row counts.  No window over customers, no
count-distinct over ``sales``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_diff, month_start
from ..functions.numeric import round_half_even


def customer_months(sales: DataFrame) -> DataFrame:
    """Per customer, the months with an order and the first of them.

    Distinct (customer, month) pairs by a hash aggregation with map-side combine;
    the second aggregation is by customer over those pairs (at most one row a month).
    """
    pairs = sales.select("customer_id", month_start("order_date").alias("year_month")).distinct()
    return pairs.groupBy("customer_id").agg(F.collect_list("year_month").alias("months"))


def cohort_assignment(sales: DataFrame) -> DataFrame:
    """First purchase month per customer."""
    return sales.groupBy("customer_id").agg(F.min(month_start("order_date")).alias("cohort_month"))


def cohort_activity(sales: DataFrame) -> DataFrame:
    """I2 + I3: every active (customer, month) with its cohort and months since it."""
    cm = customer_months(sales).select("customer_id", F.array_min("months").alias("cohort_month"),
                                       F.explode("months").alias("year_month"))
    return cm.select("customer_id", "year_month", "cohort_month",
                     month_diff("year_month", "cohort_month").alias("cohort_index"))


def cohort_counts(sales: DataFrame) -> DataFrame:
    """I4: distinct customers per (cohort month, months since first purchase)."""
    return cohort_activity(sales).groupBy("cohort_month", "cohort_index") \
                                 .agg(F.count(F.lit(1)).alias("customers"))


def retention_grid(counts: DataFrame, ages: int | None = None) -> DataFrame:
    """Customer counts per cohort as a map age -> customers over every age with a
    buyer (uncapped), or as columns ``age_0 .. age_{ages-1}`` for a stated number."""
    if ages is None:
        cells = counts.groupBy("cohort_month").agg(
            F.array_sort(F.collect_list(F.struct("cohort_index", "customers"))).alias("c"))  # one cell a month
        return cells.select("cohort_month", F.array_join(F.transform(
            "c", lambda x: F.concat_ws(":", x["cohort_index"], x["customers"])), ",").alias("customers_by_age"))
    p = counts.where(F.col("cohort_index") < ages).groupBy("cohort_month") \
              .pivot("cohort_index", list(range(ages))).agg(F.first("customers"))
    return p.select("cohort_month", *[F.col(str(i)).alias(f"age_{i}") for i in range(ages)])


def retention_heatmap(retention: DataFrame, ages: int = 13) -> DataFrame:
    """The retention heatmap: a row per cohort, ``age_0 .. age_{ages-1}`` (the
    original shows 13 ages), NULL where the cohort has no buyer of that age."""
    p = retention.where(F.col("cohort_index") < ages).groupBy("cohort_month") \
                 .pivot("cohort_index", list(range(ages))).agg(F.first("retention"))
    return p.select("cohort_month", *[F.col(str(i)).alias(f"age_{i}") for i in range(ages)])


def cohort_retention(counts: DataFrame, digits: int = 3) -> DataFrame:
    """retention = customers / cohort size (age 0), rounded half-even.

    Only (cohort, age) cells with buyers exist; nothing is zero-filled (S11).
    """
    # the size is read from the same counts (a window over each cohort's ages,
    # at most one row per month), so the counts are computed once
    size = F.max(F.when(F.col("cohort_index") == 0, F.col("customers"))) \
            .over(Window.partitionBy("cohort_month"))
    j = counts.withColumn("cohort_size", size).where(F.col("cohort_size").isNotNull())
    r = round_half_even(F.col("customers").cast("double") / F.col("cohort_size").cast("double"), digits)
    return j.withColumn("retention", r)


def retention_curve(retention: DataFrame, digits: int = 3) -> DataFrame:
    """Mean retention (in %) per age over the cohorts that have that age.

    Unweighted by cohort size; the rounded retentions are averaged as exact
    integers of 10^-digits.  ``position`` is the age's column position (S13).
    """
    scale = float(10 ** digits)
    units = F.rint(F.col("retention") * F.lit(scale)).cast("bigint")
    c = retention.groupBy("cohort_index").agg(F.sum(units).alias("u"), F.count(F.lit(1)).alias("cohorts"))
    pct = F.col("u").cast("double") / F.col("cohorts").cast("double") / F.lit(scale) * F.lit(100.0)
    pos = F.row_number().over(Window.orderBy("cohort_index")) - 1  # one row per age
    return c.select("cohort_index", pos.alias("position"), "cohorts", pct.alias("avg_retention_pct"))


def retention_milestones(curve: DataFrame, positions=(1, 3, 6, 12)) -> DataFrame:
    """I8: the curve at the given column positions (the reference's ``iloc[k]``)."""
    return curve.where(F.col("position").isin(*positions))
