"""Join row-level data with a per-group table (one row per group key).

Per-group statistics (ranges, quantiles, medians, whisker bounds) are joined
back onto the rows they summarise.  Left to the planner, a sort-merge join
would shuffle every row by the group key; with a handful of groups that puts
all rows in a handful of tasks.  The per-group table is therefore written
once with a reliable checkpoint (the shared folder named by
``spark.checkpoint.dir``), its row count is read back from that copy, and:

* at most ``LOOKUP_MAX_ROWS`` rows: broadcast (bounded by the check), the rows
  are joined where they are, no shuffle;
* more rows: the keys are many, so an ordinary shuffle join on them spreads
  the rows, and AQE splits any skewed key partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .scalars import attach_row

# Per-group tables here carry a few numeric columns (< 100 bytes a row), so
# this bound keeps a broadcast under ~10 MB.
LOOKUP_MAX_ROWS = 100_000


def checked(table: DataFrame) -> tuple[DataFrame, int]:
    """``table`` written once with a reliable checkpoint, and its row count."""
    checkpoint_dir(table.sparkSession)
    t = table.checkpoint(eager=True)
    return t, t.count()


def lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner",
                max_rows: int | None = None, size: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` on ``keys`` (``table`` has one row per key).

    Without keys ``table`` is one row and is attached with a one-row broadcast.
    ``size``: the row count when ``table`` is already a :func:`checked` copy.
    """
    keys = list(keys)
    if not keys:
        return attach_row(rows, table)
    limit = LOOKUP_MAX_ROWS if max_rows is None else max_rows
    if size is None:
        table, size = checked(table)
    if size <= limit:
        return rows.join(F.broadcast(table), keys, how)
    return rows.join(table, keys, how)
