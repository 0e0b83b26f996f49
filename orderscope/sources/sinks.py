"""A3: result sinks.

Results leave Spark as files written by the executors; only result-sized
frames (a KPI row, a 12-row ranking) are ever brought to the driver, and
then through ``records`` with an explicit row bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                 mode: str = "overwrite") -> str:
    """Write a result table (Parquet by default, or csv/json) with Spark's committer."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)
    return path


def records(df: DataFrame, max_rows: int = 10_000) -> list[dict]:
    """``to_dict('records')`` for result-sized frames; refuses larger results."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"result has more than {max_rows} rows; write it with write_report instead")
    return [r.asDict() for r in rows]
