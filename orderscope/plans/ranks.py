"""Distributed "how many values are below v" for every distinct value v.

Mid-ranks (Mann-Whitney) need a running count over the values in order.  A
window ordered by value without a partition would put every distinct value in
one task.  Groups of at most ``LEAF_MAX_DISTINCT`` distinct values are small enough
for that.  Otherwise counts are added up over the digits of
:mod:`orderscope.plans.radix`: what is below a value is what is below its first digit,
plus, within that digit, what is below its second, and so on.  Each of the four running
counts covers at most 65,536 rows, and no prefix of digits has more rows than that in
any of the joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .radix import DIGITS, with_digits

LEAF_MAX_DISTINCT = 100_000


def _below(rows: DataFrame, prefix: list[str], order: str, count: str) -> DataFrame:
    """``rows`` with ``_here``: the count before each row within its prefix."""
    before = Window.partitionBy(*prefix).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_here", F.coalesce(F.sum(count).over(before), F.lit(0)))


def values_below(vc: DataFrame, value: str, count: str, by: Sequence[str] = ()) -> DataFrame:
    """``vc`` (a written table) has one row per (by..., value) with a row ``count``; adds
    ``below`` = total count of strictly smaller values in the same group."""
    keys, cols = list(by), vc.columns
    most = vc.groupBy(*keys).agg(F.count("*").alias("d")).agg(F.max("d")).first()[0] or 0  # one number
    if most <= LEAF_MAX_DISTINCT:
        return _below(vc, keys, value, count).withColumnRenamed("_here", "below")
    rows = with_digits(vc, value)
    tables = [rows]
    for i in (3, 2, 1):  # counts by the first three, two and one digits
        tables.append(tables[-1].groupBy(*keys, *DIGITS[:i]).agg(F.sum(count).alias(count)))
    total = None
    for i, table in enumerate(reversed(tables)):
        prefix = keys + DIGITS[:i]
        here = _below(table, prefix, value if i == 3 else DIGITS[i], count)
        if total is None:
            total = here.withColumn("_off", F.col("_here"))
        else:
            total = here.join(total, prefix).withColumn("_off", F.col("_off") + F.col("_here"))
        if i < 3:
            total = total.select(*prefix, DIGITS[i], "_off")
    return total.select(*cols, F.col("_off").alias("below"))
