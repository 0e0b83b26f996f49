"""Hypothesis tests and the frequency–LTV line.

Every statistic is a closed form over one aggregation (counts, exact cent
sums, sample variances, correlation, rank sums); tail probabilities are
expressions over the one row of each test.  Mann-Whitney ranks come
from distinct-value counts plus the distributed running count of
:mod:`orderscope.plans.ranks` (no global sort in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import t_pvalue, z_pvalue
from ..functions.numeric import dec, exact_double, money, ratio
from ..plans.quantiles import medians
from ..plans.ranks import values_below
from ..plans.scalars import attach_row
from ..plans.store import stored
from .ranktests import with_exact_p

ALPHA = 0.05


def welch_stats(df: DataFrame, cents: str, flag: str) -> DataFrame:
    """Welch's t between ``flag = true`` (sample 1) and ``false`` (sample 2).

    One row: n1, n2, mean1, mean2, var1, var2 (ddof 1), t, df — of the money
    value ``cents / 100``.  Means and variances come from exact integer sums
    (``n Σc² - (Σc)²`` in decimal), so the result does not depend on the
    summation order of the partitions.
    """
    def side(b: bool, k: str):
        cond = F.col(flag) == F.lit(b)
        c = F.when(cond, F.col(cents))
        return [F.count_if(cond).alias(f"n{k}"), F.sum(c).alias(f"s{k}"),
                F.sum(dec(c) * dec(c)).alias(f"ss{k}")]
    a = df.agg(*side(True, "1"), *side(False, "2"))
    for k in ("1", "2"):
        n, s_, ss = F.col(f"n{k}"), F.col(f"s{k}"), F.col(f"ss{k}")
        a = a.withColumn(f"mean{k}", ratio(s_.cast("double"), n.cast("double")) / F.lit(100.0)) \
             .withColumn(f"var{k}", ratio(exact_double(dec(n) * ss - dec(s_) * dec(s_)),
                                          n.cast("double") * (n - 1).cast("double")) / F.lit(10000.0))
    # undefined statistics (an empty or one-row sample, no variance at all) are NULL
    s1 = ratio(F.col("var1"), F.col("n1").cast("double"))
    s2 = ratio(F.col("var2"), F.col("n2").cast("double"))
    t = ratio(F.col("mean1") - F.col("mean2"), F.sqrt(s1 + s2))
    dof = ratio((s1 + s2) * (s1 + s2), ratio(s1 * s1, (F.col("n1") - 1).cast("double"))
                + ratio(s2 * s2, (F.col("n2") - 1).cast("double")))
    return a.select("n1", "n2", "mean1", "mean2", "var1", "var2", t.alias("t"), dof.alias("df"))


def weekend_flag(sales: DataFrame) -> DataFrame:
    return sales.select((F.weekday("order_date") >= 5).alias("is_weekend"), "revenue", "cents")


def channel_samples(sales: DataFrame, rfm: DataFrame, first: str, second: str) -> DataFrame:
    """LTV of customers who *ever* ordered via each channel (samples overlap, S14).

    ``sample`` is 1 for ``first`` and 2 for ``second``.  One scan: membership
    flags per customer come from a partial aggregation (a customer with a
    third of all orders is one row per task before the shuffle), then one join
    with the per-customer table; a customer in both samples yields two rows.
    """
    ch = F.col("channel")
    who = sales.where(ch.isin(first, second)).groupBy("customer_id").agg(
        F.max(F.when(ch == F.lit(first), F.lit(1))).alias("in1"),
        F.max(F.when(ch == F.lit(second), F.lit(2))).alias("in2"))
    j = rfm.join(who, "customer_id")
    out = j.select(F.explode(F.array("in1", "in2")).alias("sample"), "customer_id", "monetary")
    return out.where(F.col("sample").isNotNull())


def mann_whitney_stats(samples: DataFrame, value: str = "monetary") -> DataFrame:
    """Two-sided Mann-Whitney U (asymptotic, continuity corrected, tie corrected).

    One row: n1, n2, u1 (the first sample's U), u2, tie_term, sigma, z and the
    two sample medians.  Rank sums are exact (decimal) and computed per
    distinct value: ``R1 = Σ n1(v)·(below(v) + (n(v)+1)/2)``.
    """
    # the values with their counts in both samples give ranks and medians: written
    # once, so the membership scan of sales runs once
    vc = stored(samples.where(F.col(value).isNotNull()).groupBy(value).agg(
        F.count_if(F.col("sample") == 1).alias("c1"),
        F.count_if(F.col("sample") == 2).alias("c2")).withColumn("c", F.col("c1") + F.col("c2")), "values")
    r = values_below(vc, value, "c")
    dec = lambda c: F.col(c).cast("decimal(38,0)")
    agg = r.agg(
        F.sum("c1").alias("n1"), F.sum("c2").alias("n2"),
        F.sum(dec("c1") * (F.lit(2) * dec("below") + dec("c") + F.lit(1))).alias("two_r1"),
        F.sum(dec("c") * dec("c") * dec("c") - dec("c")).alias("tie_term"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u1 = (F.col("two_r1") / F.lit(2) - dec("n1") * (dec("n1") + F.lit(1)) / F.lit(2)).cast("double")
    n = n1 + n2
    sigma = F.sqrt(n1 * n2 / F.lit(12.0) * ((n + F.lit(1.0)) - ratio(F.col("tie_term").cast("double"), n * (n - F.lit(1.0)))))
    a = agg.select("n1", "n2", u1.alias("u1"), F.col("tie_term").cast("double").alias("tie_term"),
                   sigma.alias("sigma"))
    a = a.withColumn("u2", F.col("n1").cast("double") * F.col("n2").cast("double") - F.col("u1"))
    z = ratio(F.greatest("u1", "u2") - F.col("n1").cast("double") * F.col("n2").cast("double") / F.lit(2.0)
              - F.lit(0.5), F.col("sigma"))  # all values tied: no spread, z is NULL
    a = a.withColumn("z", z)
    each = vc.select(F.col(value).cast("double").alias("v"), F.explode(F.array(
        F.struct(F.lit(1).alias("sample"), F.col("c1").alias("c")), F.struct(F.lit(2).alias("sample"), F.col("c2").alias("c")))).alias("s"))
    med = medians(None, value, ["sample"], out="median", counts=each.select("v", "s.sample", "s.c").where("c > 0"))
    mm = med.agg(F.max(F.when(F.col("sample") == 1, F.col("median"))).alias("median1"),
                 F.max(F.when(F.col("sample") == 2, F.col("median"))).alias("median2"))
    return attach_row(a, mm)  # both one row


def pearson_stats(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r, its t transform and df; strength per the reference."""
    a = df.agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    dof = (F.col("n") - 2).cast("double")
    t = F.when(F.abs("r") >= 1.0, F.lit(None).cast("double")) \
         .otherwise(F.col("r") * F.sqrt(dof / (F.lit(1.0) - F.col("r") * F.col("r"))))
    strength = F.when(F.abs("r") > 0.7, "strong").otherwise("moderate")
    sign = F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("none")
    return a.select("r", "n", t.alias("t"), dof.alias("df"), strength.alias("strength"), sign.alias("sign"))


def q4_monthly_split(monthly: DataFrame) -> DataFrame:
    """Monthly totals (``year_month``, ``cents``) flagged by quarter 4."""
    return monthly.select("year_month", "cents", money("cents").alias("revenue"),
                          (F.quarter("year_month") == 4).alias("is_q4"))


def hypothesis_report(weekend: DataFrame, mw: DataFrame, pearson: DataFrame, q4: DataFrame) -> DataFrame:
    """One row per test with statistic, df, p-value and the verdict ``p < 0.05``.

    Mann-Whitney is exact where a sample has at most eight values and none are tied,
    asymptotic otherwise."""
    w = weekend.select(F.lit("weekend_vs_weekday_aov").alias("test"), F.col("t").alias("statistic"),
                       F.col("df"), t_pvalue(F.col("t"), F.col("df")).alias("p_value"))
    m = with_exact_p(mw.withColumn("test", F.lit("email_vs_social_ltv")), ["test"])
    m = m.select("test", F.col("u1").alias("statistic"), F.lit(None).cast("double").alias("df"),
                 F.coalesce("p_exact", z_pvalue(F.col("z"))).alias("p_value"))
    p = pearson.select(F.lit("frequency_vs_ltv_pearson").alias("test"), F.col("r").alias("statistic"),
                       F.col("df"),
                       F.when(F.abs("r") >= 1.0, F.lit(0.0)).otherwise(t_pvalue(F.col("t"), F.col("df")))
                       .alias("p_value"))
    q = q4.select(F.lit("q4_vs_other_months").alias("test"), F.col("t").alias("statistic"),
                  F.col("df"), t_pvalue(F.col("t"), F.col("df")).alias("p_value"))
    out = w.unionByName(m).unionByName(p).unionByName(q)
    return out.withColumn("significant", F.col("p_value") < F.lit(ALPHA))


def hash_rank(col: str, mult: int = 2654435761, mod: int = 2 ** 32) -> Column:
    """Deterministic pseudo-random order key: ``(id * mult) mod 2^32`` (exact decimal)."""
    return F.pmod(F.col(col).cast("decimal(38,0)") * F.lit(mult).cast("decimal(38,0)"),
                  F.lit(mod).cast("decimal(38,0)")).cast("bigint")


def sample_customers(rfm: DataFrame, n: int = 1000) -> DataFrame:
    """A seeded sample of at most ``n`` customers (the limit is the feature).

    Plans as a distributed top-k on the hash key.
    """
    return rfm.withColumn("_h", hash_rank("customer_id")).orderBy("_h", "customer_id").limit(n) \
              .select("customer_id", "frequency", "monetary")


def with_cents(rfm: DataFrame) -> DataFrame:
    """Monetary back to exact cents (it is a sum of cents / 100)."""
    return rfm.withColumn("cents", F.rint(F.col("monetary") * F.lit(100.0)).cast("bigint"))


def fit_line(sample: DataFrame, x: str = "frequency", y_cents: str = "cents", points: int = 100) -> DataFrame:
    """Degree-1 least-squares line of money ``y_cents/100`` on integer ``x``
    and ``points`` evenly spaced x values (``linspace``).

    Slope and intercept are ratios of exact integer sums (normal equations), NULL
    where all x are equal.
    """
    a = sample.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y_cents).alias("sy"),
                   F.sum(dec(x) * dec(y_cents)).alias("sxy"), F.sum(dec(x) * dec(x)).alias("sxx"),
                   F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    den = exact_double(dec("n") * F.col("sxx") - dec("sx") * dec("sx"))
    slope = ratio(exact_double(dec("n") * F.col("sxy") - dec("sx") * dec("sy")), den) / F.lit(100.0)
    icpt = ratio(exact_double(dec("sy") * F.col("sxx") - dec("sx") * F.col("sxy")), den) / F.lit(100.0)
    a = a.select(slope.alias("slope"), icpt.alias("intercept"), "lo", "hi")
    g = a.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(points - 1))
    xv = F.when(F.col("i") == points - 1, F.col("hi")).otherwise(F.col("i").cast("double") * step + F.col("lo"))
    return g.select("i", xv.alias("x"), "slope", "intercept") \
            .withColumn("y", F.col("slope") * F.col("x") + F.col("intercept"))
