"""Attach a one-row table (global statistics, edges, centroid arrays) to every row.

The table is read as a scalar subquery: Spark runs it once, hands its one row to
the tasks as a constant, and fails if there are several rows.  There is no join.
Without a row the columns are NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of the one-row table ``one_row`` appended."""
    row = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("row")).scalar()
    out = df.withColumn("_row", row)
    return out.select(*df.columns, *[F.col("_row")[c].alias(c) for c in one_row.columns])
