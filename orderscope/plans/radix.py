"""Order statistics by radix: a double as four 16-bit digits that sort as it does.

The bits of a double, with all but the sign turned round for negative values, order
as signed 64-bit integers exactly as the values do.  Cut into four digits, every
prefix of digits has at most 65,536 next digits, whatever the values are: counts of
one digit below a prefix are a bounded table, and a running count over them a bounded
sort.  Four such aggregations locate any rank or give every value's rank, with no levels
that depend on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = ["_d1", "_d2", "_d3", "_d4"]


def image(value: str) -> Column:
    """A bigint that orders as the double ``value`` (-0.0 as 0.0)."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col(value).cast("double") + F.lit(0.0)).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def with_digits(df: DataFrame, value: str) -> DataFrame:
    """``df`` with the digits of ``value``, the first signed, the others from 0 on."""
    x = df.withColumn("_image", image(value))
    low = F.lit(0xFFFF).cast("bigint")
    parts = {d: F.shiftright("_image", s).bitwiseAND(low).cast("int") for d, s in zip(DIGITS[1:], (32, 16, 0), strict=True)}
    return x.withColumns({DIGITS[0]: F.shiftright("_image", 48).cast("int"), **parts}).drop("_image")
