"""Overview KPIs and the final project summary.

Each piece is a one-row aggregate from its own family; the pieces are
attached side by side (scalar subqueries).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_start
from ..functions.numeric import money, ratio
from . import cohorts as I
from . import forecast as K
from . import segments as G
from ..plans.scalars import attach_row
from ..session import checkpoint_dir


def activity(sales: DataFrame) -> DataFrame:
    """Cents and orders per customer and month (``order_date``: its first day), written
    once: totals, the monthly series and the cohorts all come from this table, so
    ``sales`` is scanned once for them."""
    act = sales.groupBy("customer_id", month_start("order_date").alias("order_date")).agg(
        F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("orders"))
    checkpoint_dir(sales.sparkSession)
    return act.checkpoint(eager=True)


def totals(act: DataFrame, year_a: int, year_b: int) -> DataFrame:
    """One row from :func:`activity`: total revenue, distinct customers, AOV and the
    cents of the two compared years."""
    y = F.year("order_date")
    return act.agg(money(F.sum("cents")).alias("total_revenue"),
                     F.countDistinct("customer_id").alias("customers"),
                     (ratio(F.sum("cents").cast("double"), F.sum("orders").cast("double")) / F.lit(100.0)).alias("aov"),
                     F.coalesce(F.sum(F.when(y == year_a, F.col("cents"))), F.lit(0)).alias("ca"),
                     F.coalesce(F.sum(F.when(y == year_b, F.col("cents"))), F.lit(0)).alias("cb"))


def champions(seg: DataFrame, name: str = G.SEGMENTS[0]) -> DataFrame:
    """Champion customers and their share of all customer revenue (unrounded)."""
    c = F.rint(F.col("monetary") * 100.0).cast("bigint")
    is_c = F.col("segment") == F.lit(name)
    own = F.coalesce(F.sum(F.when(is_c, c)), F.lit(0)).cast("double")
    return seg.agg(F.count_if(is_c).alias("champion_customers"),
                   (ratio(own, F.sum(c).cast("double")) * F.lit(100.0)).alias("champions_share_pct"))


def overview_kpis(sales: DataFrame, seg: DataFrame, year_a: int, year_b: int, horizon: int = 6) -> DataFrame:
    """L1: revenue, YoY %, customers, AOV, Champions revenue share, forecast total."""
    act = activity(sales)
    t = totals(act, year_a, year_b)
    yoy = (ratio((F.col("cb") - F.col("ca")).cast("double"), F.col("ca").cast("double")) * F.lit(100.0)).alias("yoy_pct")
    fc = K.forecast(K.monthly_series(act), horizon).agg(F.sum("forecast").alias("forecast_total"))
    out = attach_row(attach_row(t, champions(seg)), fc)  # one row each
    return out.select("total_revenue", yoy, "customers", "aov", "champions_share_pct", "forecast_total")


def project_summary(sales: DataFrame, seg: DataFrame, year_a: int, year_b: int, horizon: int = 6) -> DataFrame:
    """L2: the notebook's closing table (YoY as ``b/a - 1``; month-1 retention is
    the average curve at column position 1; champion share from the rounded
    segment summary)."""
    act = activity(sales)
    t = totals(act, year_a, year_b)
    yoy = ((ratio(F.col("cb").cast("double"), F.col("ca").cast("double")) - F.lit(1.0)) * F.lit(100.0)).alias("yoy_pct")
    curve = I.retention_curve(I.cohort_retention(I.cohort_counts(act)))
    m1 = curve.where(F.col("position") == 1).select(F.col("avg_retention_pct").alias("month1_retention_pct"))
    ss = G.segment_summary(seg).where(F.col("segment") == F.lit(G.SEGMENTS[0])) \
          .select(F.col("customers").alias("champion_customers"), F.col("revenue_share").alias("champion_share_pct"))
    fc = K.forecast(K.monthly_series(act), horizon).agg(F.sum("forecast").alias("forecast_total"))
    out = attach_row(attach_row(attach_row(t, m1), fc), ss)
    return out.select("total_revenue", yoy, "month1_retention_pct", "customers", "champion_customers",
                      "champion_share_pct", "forecast_total")
