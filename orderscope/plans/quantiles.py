"""Exact quantiles (NumPy ``linear`` method and ``np.median``) as a distributed plan.

Spark's built-in ``percentile`` keeps one value->count map per group and merges
it in a single task, and ``percentile_approx`` is not exact.  This plan finds
the exact order statistics with only aggregations, joins of small tables and
bounded windows:

1. ``vc``   distinct-value counts per group (partial aggregation: a group or a
   value holding a third of all rows is collapsed map-side).
2. ``g``    per group ``n`` (one row per group) and the wanted 0-based ranks ``k``
   (two per probability: the interpolation pair).
3. If every group has at most ``LEAF_MAX_DISTINCT`` distinct values: one running
   count over them, a bounded sort per task.
4. Otherwise radix selection (:mod:`orderscope.plans.radix`): four times, the rows
   below each wanted prefix of digits are counted by their next digit, and the digit
   that holds the rank is kept.  A running count covers at most 65,536 rows,
   all groups, probabilities and columns share the four aggregations, and after the
   last digit one value is left for each rank.

``vc`` and each digit's small table of prefixes are written with a reliable
``checkpoint()`` (the shared folder named by ``spark.checkpoint.dir``): the
input is scanned once, the lineage is cut, and a lost executor never forces
recomputing the input.

The interpolation matches NumPy bit for bit: virtual index ``(n-1)*p``,
``gamma = index - floor(index)`` and NumPy's two-sided ``_lerp``; the median
mode is ``np.median`` (mean of the middle pair).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import lerp
from ..session import checkpoint_dir
from .lookups import checked, lookup_join
from .radix import DIGITS, with_digits

# Up to this many distinct values of a group are sorted in one task (a few MB).
LEAF_MAX_DISTINCT = 100_000
_G = "_qgroup"


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., v, c)``: each group's distinct non-NULL values (as double) with
    their row counts, written once with a reliable checkpoint.

    A partial aggregation (a value or group holding a third of all rows is
    collapsed map-side).  Quantiles, box statistics and histograms of the
    same column can all start from one such table, so the input is scanned
    once.
    """
    x = df.select(*by, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    vc = x.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c"))
    checkpoint_dir(df.sparkSession)
    return vc.checkpoint(eager=True)


def _prep(df: DataFrame | None, value: str, by: Sequence[str], counts: DataFrame | None = None):
    vc = value_counts(df, value, by) if counts is None else counts
    keys = list(by) if by else [_G]
    if not by:
        vc = vc.withColumn(_G, F.lit(0))
    g = vc.groupBy(*keys).agg(F.sum("c").alias("n"))
    return keys, vc, g


def _targets(g: DataFrame, keys: list[str], probs: Sequence[float], median: bool) -> DataFrame:
    """One row per (group, prob index i, side j) with the 0-based rank ``k`` to fetch."""
    n1 = (F.col("n") - F.lit(1)).cast("double")
    if median:
        # np.median: middle element (odd n) or the two middle elements (even n)
        rows = g.select(*keys, F.lit(0).alias("i"), F.col("n"),
                        F.floor(n1 / F.lit(2.0)).cast("bigint").alias("k0"),
                        F.ceil(n1 / F.lit(2.0)).cast("bigint").alias("k1"),
                        F.lit(0.5).alias("t"))
    else:
        arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                        for i, p in enumerate(probs)])
        rows = g.select(*keys, F.col("n"), F.explode(arr).alias("ip")) \
                .select(*keys, "n", F.col("ip.i").alias("i"), (n1 * F.col("ip.p")).alias("pos"))
        last = F.col("pos") >= n1
        k0 = F.when(last, F.col("n") - 1).otherwise(F.floor("pos")).cast("bigint")
        k1 = F.when(last, F.col("n") - 1).otherwise(F.floor("pos") + 1).cast("bigint")
        t = F.col("pos") - F.when(last, F.lit(-1.0)).otherwise(F.floor("pos").cast("double"))
        rows = rows.select(*keys, "i", "n", k0.alias("k0"), k1.alias("k1"), t.alias("t"))
    side = F.explode(F.array(F.struct(F.lit(0).alias("j"), F.col("k0").alias("k")),
                             F.struct(F.lit(1).alias("j"), F.col("k1").alias("k"))))
    return rows.select(*keys, "i", "t", side.alias("s")).select(*keys, "i", "t", "s.j", "s.k")


def _locate_radix(vc: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Value at rank ``k`` for every target row, digit by digit."""
    rows = with_digits(vc, "v")
    win, size = targets.select(*keys, "k").distinct().withColumn("off", F.lit(0).cast("bigint")), None
    for i, digit in enumerate(DIGITS):
        prefix = keys + DIGITS[:i]
        if i:  # only values below a prefix that holds a wanted rank
            rows = lookup_join(rows, win.select(*prefix).distinct(), prefix, size=size)
        count = rows.groupBy(*prefix, digit).agg(F.sum("c").alias("pc"), F.max("v").alias("v"))
        before = Window.partitionBy(*prefix).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        count = count.withColumn("ps", F.coalesce(F.sum("pc").over(before), F.lit(0)))
        start = F.col("off") + F.col("ps")
        win = win.join(count, prefix).where((F.col("k") >= start) & (F.col("k") < start + F.col("pc")))
        win, size = checked(win.select(*prefix, digit, "k", start.alias("off"), "v").drop(*([] if i == 3 else ["v"])))
    return targets.join(win.select(*keys, "k", "v"), keys + ["k"]).select(*keys, "i", "t", "j", "v")


def _locate_direct(vc: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Groups within the leaf bound: running count over each group's distinct values."""
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    r = vc.withColumn("s", F.coalesce(F.sum("c").over(w), F.lit(0)))
    hit = targets.alias("t").join(
        r.alias("r"),
        [F.col(f"t.{k}") == F.col(f"r.{k}") for k in keys]
        + [F.col("t.k") >= F.col("r.s"), F.col("t.k") < F.col("r.s") + F.col("r.c")],
    )
    return hit.select(*[F.col(f"t.{k}") for k in keys], "t.i", "t.t", "t.j", "r.v")


def max_distinct(vc: DataFrame, keys: list[str]) -> int:
    """Size check on the checkpointed counts: the largest group's distinct values."""
    row = vc.groupBy(*keys).agg(F.count(F.lit(1)).alias("d")).agg(F.max("d")).collect()[0]
    return int(row[0] or 0)


def quantiles(df: DataFrame | None, value: str, probs: Sequence[float], by: Sequence[str] = (),
              out: Sequence[str] | None = None,
              with_count: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Exact ``np.percentile(x, 100*p, method='linear')`` per group.

    Returns one row per group: ``by...`` and one column per prob (named ``out``).
    NULL values are ignored (pandas ``quantile`` skips NaN).  ``counts``: a
    :func:`value_counts` table of the same column to start from.
    """
    return _quantiles(df, value, probs, by, out, with_count, median=False, counts=counts)


def medians(df: DataFrame | None, value: str, by: Sequence[str] = (), out: str = "median",
            with_count: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Exact ``np.median`` per group (pandas ``groupby().median()``)."""
    return _quantiles(df, value, [0.5], by, [out], with_count, median=True, counts=counts)


def _quantiles(df, value, probs, by, out, with_count, median, counts=None):
    out = list(out) if out else [f"q{i}" for i in range(len(probs))]
    keys, vc, g = _prep(df, value, by, counts)
    tg = _targets(g, keys, probs, median)
    locate = _locate_direct if max_distinct(vc, keys) <= LEAF_MAX_DISTINCT else _locate_radix
    hit = locate(vc, tg, keys)
    pair = hit.groupBy(*keys, "i", "t").agg(
        F.max(F.when(F.col("j") == 0, F.col("v"))).alias("a"),
        F.max(F.when(F.col("j") == 1, F.col("v"))).alias("b"))
    q = (F.col("a") + F.col("b")) / F.lit(2.0) if median else lerp("a", "b", "t")
    pair = pair.withColumn("q", q)
    res = pair.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(name)
                                    for i, name in enumerate(out)])
    if with_count:
        res = res.join(g.select(*keys, "n"), keys)
    if not by:
        res = res.drop(_G)
    return res
